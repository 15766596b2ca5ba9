from driftline.operators import projects


def tree(spark, files):
    return spark.createDataFrame(list(files.items()), "path string, text string")


def context(spark, files, root=""):
    rows = projects.contexts(tree(spark, files), spark.createDataFrame([(root,)], "root string")).collect()
    assert len(rows) == 1
    return rows[0]


POM = "<project><packaging>pom</packaging><modules><module>core</module> <module> web </module></modules><artifactId>parent</artifactId></project>"


def test_roots(spark):
    files = {"pom.xml": POM, "core/pom.xml": "<artifactId>core</artifactId>", "web/pom.xml": "", "tools/pom.xml": "", "web/ui/package.json": "{}", "svc/go.mod": "", "web/node_modules/x/package.json": "{}", ".hidden/pom.xml": "", "x@tmp/pom.xml": "",
             "deep/a/pom.xml": POM, "deep/a/core/pom.xml": "", "deep/a/b/core/pom.xml": "", "py/requirements.txt": "", "README.md": ""}
    got = sorted(r.root for r in projects.roots(tree(spark, files)).collect())
    assert got == ["", "deep/a", "py", "svc", "tools", "web/ui"]
    assert [r.root for r in projects.roots(tree(spark, {"src/A.java": ""})).collect()] == [""]


def test_maven(spark):
    files = {"pom.xml": POM + "<artifactId>spring-core</artifactId><artifactId>mybatis</artifactId>", "core/src/main/java/com/x/a/OrderMapper.java": None, "core/src/main/java/com/x/b/c/PayService.java": None, "web/src/main/java/com/x/UserController.java": None,
             "web/src/main/java/com/x/ShopApplication.java": "class A { public static void main(String[] a) {} }", "web/src/main/java/com/x/WrapperUtil.java": "public static void main", "web/src/main/resources/application-dev.yml": None, "web/app.conf": None, "target/x/Application.java": "public static void main"}
    got = context(spark, files)
    assert got.build_system == "Maven" and got.modules == ["core", "web"] and got.dependencies == ["parent", "spring-core", "mybatis"] and got.tech_stack == ["Maven", "Spring", "MyBatis"]
    assert got.entry_points == ["web/src/main/java/com/x/ShopApplication.java"] and got.configs == ["web/app.conf", "web/src/main/resources/application-dev.yml"]
    assert got.conventions == ["Java 包根：com.x（公共 2 级 / 最深 4 级）", "持久层命名 *Mapper/*Dao（1 个）", "服务层命名 *Service（1 个）", "接口/控制层命名 *Controller/*Resource（1 个）"]
    assert got.summary.startswith("多模块工程（Maven），模块含 core、web；入口/主类：web/src/main/java/com/x/ShopApplication.java；约定：Java 包根")


def test_others(spark):
    got = context(spark, {"build.gradle": "implementation 'org.redis:redis:1'\n  api(\"k:kafka:2\")", "settings.gradle": "include ':a:b'\ninclude(\"c\")"})
    assert (got.build_system, got.modules, got.dependencies, got.tech_stack) == ("Gradle", ["/a/b", "c"], ["org.redis:redis:1", "k:kafka:2"], ["Gradle", "Redis", "消息队列"])
    got = context(spark, {"package.json": '{"vue": "3", "long": "1.2.3"}', "src/App.vue": None, "index.html": None})
    assert (got.build_system, got.dependencies, got.entry_points, got.tech_stack) == ("npm", ["vue"], ["index.html", "src/App.vue"], ["npm", "前端框架"]) and got.summary == "单模块工程（npm）；入口/主类：index.html、src/App.vue；"
    got = context(spark, {"p/WEB-INF/lib/spring-5.jar": None, "p/WEB-INF/web.xml": None, "p/META-INF/MANIFEST.MF": "Implementation-Title: Shop\nImplementation-Version: 2\n", "p/WEB-INF/classes/version.properties": None}, "p")
    assert got.build_system == projects.WAR and got.dependencies == ["spring-5"] and got.configs == ["META-INF/MANIFEST.MF", "WEB-INF/classes/version.properties", "WEB-INF/web.xml"]
    assert got.conventions == ["WEB-INF/lib 依赖库 1 个", "部署包标识：Shop v2"] and got.summary.startswith("未识别到标准构建系统，按目录特征推断为 Java Web")
    got = context(spark, {"a/pom.xml": "", "b/package.json": "", "x.txt": None})
    assert (got.build_system, got.modules) == ("none", ["a", "b"])
    assert context(spark, {"x.txt": None}).summary.startswith("未识别到标准构建系统，仅基于目录结构推断")
    assert context(spark, {"A.java": "", "B.java": ""}).build_system == projects.SOURCES and context(spark, {"x.class": None}).build_system == projects.BYTECODE


def test_lists_are_capped(spark):
    files = {"pom.xml": "".join(f"<module>m{i:03}</module><artifactId>d{i:03}</artifactId>" for i in range(100)), **{f"w{i:03}/index.html": None for i in range(50)}, **{f"c{i:03}.conf": None for i in range(50)}}
    got = context(spark, files)
    assert got.modules == [f"m{i:03}" for i in range(40)] and got.dependencies == [f"d{i:03}" for i in range(60)] and got.entry_points == [f"w{i:03}/index.html" for i in range(20)] and len(got.configs) == 20


def test_files_count_for_every_project_above(spark):
    files = {"package.json": "{}", "a/package.json": "{}", "a/index.html": None, "b/index.html": None}
    rows = {r.root: r.entry_points for r in projects.contexts(tree(spark, files), projects.roots(tree(spark, files))).collect()}
    assert rows == {"": ["a/index.html", "b/index.html"], "a": ["index.html"]}
