"""Finding source files and naming their modules; the content-hash cache of parses."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Directory names that are never entered.
DEFAULT_EXCLUDES = ("__pycache__", "node_modules", ".git", "dist", "tests", "__tests__", ".next", "build", ".venv", "venv", "target", "vendor")
#: File extensions by language.
EXTENSIONS = {"py": "Python", "ts": "TypeScript", "tsx": "TypeScript", "go": "Go", "rs": "Rust", "php": "Php"}
#: Endings of test files.
TEST_FILES = r"(\.(test|spec)\.(ts|tsx|js|jsx)|\.test\.py|_test\.py|_test\.go|Test\.php)$"
CACHE_VERSION = 1
ROOT_SHARE, WARN_FILES, WARN_RATIO = 0.6, 10, 3


@dataclass(frozen=True)
class LocalPrefix:
    """A project's prefix: one (put before module ids that lack it) or several (top segments only, nothing is put before)."""

    values: tuple[str, ...] = ()
    wrap: bool = True

    @classmethod
    def of(cls, value: str | list[str] | None) -> LocalPrefix:
        if value is None or value == "":
            return cls()
        if isinstance(value, str):
            return cls((value,))
        if not value or any(not isinstance(x, str) or not x.strip() for x in value):
            raise ValueError("local_prefix must be a string or a list of non-empty strings")
        if any("." in x or "/" in x for x in value):
            raise ValueError("local_prefix entries are single segments")
        return cls(tuple(dict.fromkeys(value)), wrap=False)

    @property
    def cache_key(self) -> str:
        return (self.values[0] if self.values else "") if self.wrap else "multi:" + "|".join(sorted(self.values))

    @property
    def put_before(self) -> str:
        return self.values[0] if self.wrap and self.values else ""

    def matches(self, module: Column) -> Column:
        """The module's top segment is one of the prefixes."""
        return F.substring_index(module, ".", 1).isin(*self.values) if self.values else F.lit(False)


def language_of(path: Column) -> Column:
    ext = F.lower(F.regexp_extract(path, r"\.([A-Za-z]+)$", 1))
    table = F.create_map(*[F.lit(x) for pair in EXTENSIONS.items() for x in pair])
    return F.element_at(table, ext)


def is_test_file(path: Column) -> Column:
    return F.substring_index(path, "/", -1).rlike(TEST_FILES)


def module_name(path: Column, language: Column, prefix: str = "") -> Column:
    """The dotted module id of a path under the project root: package files stand for their folder, Go files too."""
    folder = F.regexp_replace(F.regexp_extract(path, r"^(.*)/[^/]*$", 1), "/", ".")
    name = F.substring_index(path, "/", -1)
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    package = is_package(path)
    dotted = F.when(package, folder).otherwise(F.concat_ws(".", F.nullif(folder, F.lit("")), stem))
    go = F.when(folder == "", F.lit(prefix) if prefix else stem).otherwise(folder)
    out = F.when(language == "Go", go).otherwise(dotted)
    return F.when(F.lit(prefix == "") | out.startswith(prefix), out).otherwise(F.concat(F.lit(prefix + "."), out))


def is_package(path: Column) -> Column:
    return F.substring_index(path, "/", -1).isin("__init__.py", "index.ts", "index.tsx", "mod.rs", "lib.rs", "main.rs")


def psr4_module(path: Column, mappings: list[tuple[str, str]], otherwise: Column) -> Column:
    """A PHP module by the longest folder of (namespace, folder) that its path begins with."""
    out = otherwise
    for space, folder in sorted(mappings, key=lambda m: len(m[1])):
        rest = F.regexp_replace(F.substring(path, F.lit(len(folder) + 1), F.length(path)), r"\.php$", "")
        head = space.rstrip("\\").replace("\\", "/")
        full = F.concat(F.lit(head + "/"), rest) if head else rest
        out = F.when(path.startswith(folder), F.translate(full, "/\\", "..")).otherwise(out)
    return out


def discover(spark: SparkSession, project: str, root: str, languages: list[str], prefix: str = "", excludes: tuple[str, ...] = (), psr4: list[tuple[str, str]] | None = None, content: bool = True) -> DataFrame:
    """files(project, path, language, module_name, is_package, content, sha256) below a root, tests and excluded folders left out.

    An empty prefix detects one (see detect_prefix). Unreadable languages and other extensions are ignored.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{" + ",".join(EXTENSIONS) + "}").load(root)
    base = root.rstrip("/") + "/"
    base = base if "://" in base or base.startswith("file:") else "file:" + base
    path = F.regexp_replace(F.expr("path"), "^" + _quoted(base.replace("file:///", "file:/")), "")
    files = raw.select(path.alias("path"), *(["content"] if content else []))
    if empty := empty_files(spark, root):
        more = spark.createDataFrame([(x.removeprefix(base).removeprefix(base.replace("file:///", "file:/")),) for x in empty], "path string")
        files = files.unionByName(more.withColumn("content", F.lit(b"")) if content else more)
    banned = F.array(*[F.lit(x) for x in (*DEFAULT_EXCLUDES, *excludes)])
    folders = F.slice(F.split("path", "/"), F.lit(1), F.size(F.split("path", "/")) - 1)
    files = files.withColumn("language", language_of(F.col("path"))).filter(F.col("language").isin(languages)).filter(~is_test_file(F.col("path"))).filter(~F.arrays_overlap(folders, banned))
    name = module_name(F.col("path"), F.col("language"), prefix)
    if psr4:
        name = F.when(F.col("language") == "Php", psr4_module(F.col("path"), psr4, name)).otherwise(name)
    out = files.select(F.lit(project).alias("project"), "path", "language", name.alias("module_name"), is_package(F.col("path")).alias("is_package"), *(["content", F.sha2("content", 256).alias("sha256")] if content else []))
    return out


def empty_files(spark: SparkSession, root: str) -> list[str]:
    """Paths of source files without a byte: Spark's readers skip them, but an empty package file is a module."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    found, out = path.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(path, True), []
    while found.hasNext():
        f = found.next()
        name = f.getPath().toString()
        if f.getLen() == 0 and name.rpartition(".")[2] in EXTENSIONS:
            out.append(name)
    return out


def _quoted(text: str) -> str:
    import re

    return re.sub(r"([^\w/:])", r"\\\1", text)


def root_counts(files: DataFrame) -> DataFrame:
    """(project, root, n): files by first folder; files at the top count as root ''."""
    first = F.when(F.col("path").contains("/"), F.substring_index("path", "/", 1)).otherwise("")
    return files.groupBy("project", first.alias("root")).agg(F.count(F.lit(1)).alias("n"))


def detect_prefix(files: DataFrame) -> DataFrame:
    """(project, prefix, ambiguous): 'src' or else 'app' if more than 60 % of the files are there, else ''.

    ambiguous: two or more roots of ten files, the largest below three times the second.
    """
    counts = root_counts(files)
    share = counts.groupBy("project").agg(F.sum("n").alias("all"), F.max(F.when(F.col("root") == "src", F.col("n"))).alias("src"), F.max(F.when(F.col("root") == "app", F.col("n"))).alias("app"), F.sort_array(F.collect_list(F.when((F.col("root") != "") & (F.col("n") >= WARN_FILES), F.col("n"))), asc=False).alias("big"))
    prefix = F.when(F.col("src") > ROOT_SHARE * F.col("all"), "src").when(F.col("app") > ROOT_SHARE * F.col("all"), "app").otherwise("")
    unclear = (F.size("big") >= 2) & (F.get("big", F.lit(0)) < WARN_RATIO * F.get("big", F.lit(1)))
    return share.select("project", prefix.alias("prefix"), F.coalesce(unclear, F.lit(False)).alias("ambiguous"))


def split_cached(files: DataFrame, cache: DataFrame | None, prefix_key: str = "", version: int = CACHE_VERSION) -> tuple[DataFrame, DataFrame | None]:
    """Files to parse, and the cached parses that still hold: same path and content hash, same version and prefix key."""
    if cache is None:
        return files, None
    valid = cache.filter((F.col("version") == version) & (F.col("prefix_key") == prefix_key)).drop("version", "prefix_key")
    keys = ["project", "path", "sha256"]
    return files.join(valid.select(*keys), keys, "left_anti"), valid.join(files.select(*keys), keys, "left_semi")


def cache_stats(files: DataFrame, cache: DataFrame) -> DataFrame:
    """(project, hits, misses, evicted): evicted are cached paths that are gone."""
    both = files.select("project", "path", "sha256", F.lit(1).alias("f")).join(cache.select("project", "path", F.col("sha256").alias("old"), F.lit(1).alias("c")), ["project", "path"], "full_outer")
    return both.groupBy("project").agg(F.count_if(F.col("f").isNotNull() & (F.col("sha256") == F.col("old"))).alias("hits"), F.count_if(F.col("f").isNotNull() & ~F.coalesce(F.col("sha256") == F.col("old"), F.lit(False))).alias("misses"), F.count_if(F.col("f").isNull()).alias("evicted"))
