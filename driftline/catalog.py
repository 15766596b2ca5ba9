"""The queries of the comparison engine by name, and their SQL."""

from .plans import compare, content, documents, files, forms, reports, sources, trees

QUERIES: dict = compare.QUERIES | content.QUERIES | files.QUERIES | forms.QUERIES | reports.QUERIES | sources.QUERIES | trees.QUERIES | documents.QUERIES
SQL: dict = compare.SQL | content.SQL | files.SQL | forms.SQL | reports.SQL | sources.SQL | trees.SQL | documents.SQL
