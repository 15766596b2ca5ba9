from driftline.functions.java_source import apis, normal_form

SVC = """package a.b;
public class Svc { public String hello(String n) { return "{" + n; } public int run(int k) { return k; } protected java.util.List<String> items() { return null; } private void secret() { } public static final int VER = 1;
  static class In { public void deep(int[] x, String y[]) { } } }"""


def test_apis():
    assert apis(SVC) == [("a.b.Svc", "hello(String):String"), ("a.b.Svc", "run(int):int"), ("a.b.Svc", "items():java.util.List<String>"), ("a.b.Svc", "VER:int"), ("a.b.Svc.In", "deep(int[],String[]):void")]
    assert apis("class A { void x() { } }") == []
    for broken in ("class A { void x() { }", "class A } {", "int x = 1;", "", None, 'class A { String s = "open; }', "package a;"):
        assert apis(broken) is None
    assert apis("interface I { int X = 1; public <T extends Comparable<T>> T of(T a, java.util.Map<String, T[]> m); }") == [("I", "of(T,java.util.Map<String, T[]>):T")]


def test_normal_form():
    moved = SVC.replace("private void secret() { }", "").replace("public class Svc {", "public class Svc { // {\n  private   void secret( ) {}\n /* } */")
    assert normal_form(moved) == normal_form(SVC)
    assert normal_form(SVC.replace("return k;", "return k + 1;")) != normal_form(SVC)
    assert normal_form(SVC.replace("deep(int[] x", "deep(int[] z")) != normal_form(SVC)
    assert normal_form(SVC[:-1]) is None and normal_form("") is None


def test_long_source():
    body = "".join(f"  public int m{i}(int a) {{ if (a > {i}) {{ return a; }} return {i}; }}\n" for i in range(600))
    assert len(apis("class Big {\n" + body + "}")) == 600


def test_sources_are_read_once_however_often_their_outlines_are(spark):
    from driftline.plans import sources

    found = sources.api_compatibility(spark, "/root/testdata/sf0.001")
    assert "MapInPandas" not in found._jdf.queryExecution().executedPlan().toString() and found.count() > 0
