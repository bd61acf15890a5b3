"""Sources: application archives, method text, manifests, permission mappings, labels, units, prototypes."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schemas
from ..functions import text as T


def parse_years(spec) -> list[str] | None:
    """Years out of a range `a-b` (either way round), a comma list, or nested lists of these; sorted, distinct. None or "": all."""
    if spec is None or spec == "":
        return None
    if isinstance(spec, (list, tuple, set)):
        return sorted({y for x in spec for y in parse_years(x) or []})
    out: set[str] = set()
    for part in str(spec).split(","):
        part = part.strip()
        if m := re.fullmatch(r"(\d+)\s*-\s*(\d+)", part):
            a, b = sorted(map(int, m.groups()))
            out |= {str(y) for y in range(a, b + 1)}
        elif part:
            out.add(part)
    return sorted(out)


def in_years(column: Column, spec) -> Column:
    """Filter on the year column; a year partition is pruned by it."""
    years = parse_years(spec)
    return F.lit(True) if years is None else column.isin(years)


def list_apks(spark: SparkSession, root: str, years=None, single: str | None = None, limit: int = 0) -> DataFrame:
    """(year, apk_sha256, apk_path) of the archives under root/<year>/, in order of year and path.

    single selects one archive by its file stem or path suffix; limit > 0 takes the first rows.
    """
    files = spark.read.format("binaryFile").load(f"{root}/*/*.apk").select("path")
    apks = files.select(F.regexp_extract("path", r"/([^/]+)/[^/]+$", 1).alias("year"), T.sha_from_path(F.col("path")).alias("apk_sha256"), F.col("path").alias("apk_path"))
    if single:
        apks = apks.where((F.col("apk_sha256") == single.upper()) | F.col("apk_path").endswith(single))
    else:
        apks = apks.where(in_years(F.col("year"), years))
    apks = apks.orderBy("year", "apk_path")
    return apks.limit(limit) if limit > 0 else apks


def _dex_members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for path, content in zip(pdf["path"], pdf["content"], strict=True):
            try:
                names = zipfile.ZipFile(io.BytesIO(content)).namelist()
            except zipfile.BadZipFile as e:
                rows.append((path, None, None, str(e)))
                continue
            for name in names:
                if m := re.fullmatch(r"classes(\d*)\.dex", name.rsplit("/", 1)[-1]):
                    rows.append((path, name, int(m[1] or 1), None))
        yield pd.DataFrame(rows, columns=["apk_path", "dex", "ord", "error"])


def list_dex(spark: SparkSession, root: str) -> DataFrame:
    """S3, K5: (apk_path, dex, ord, error) of each archive's classes files, to be ordered by ord; unreadable archives give an error row."""
    files = spark.read.format("binaryFile").load(f"{root}/*/*.apk")
    return files.select("path", "content").mapInPandas(_dex_members, "apk_path string, dex string, ord int, error string")


def disassemble(apks: DataFrame, tool: Callable[[str], list[tuple[str, str]]]) -> DataFrame:
    """Run an injected disassembler on each archive: path -> [(file, text)]. Failures become error rows; the batch goes on."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for year, sha, path in pdf[["year", "apk_sha256", "apk_path"]].itertuples(index=False):
                try:
                    rows += [(year, sha, file, body, None) for file, body in tool(path)]
                except Exception as e:  # noqa: BLE001  any tool's failure is data here
                    rows.append((year, sha, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["year", "apk_sha256", "file", "body", "error"])

    return apks.mapInPandas(run, "year string, apk_sha256 string, file string, body string, error string")


def read_smali(spark: SparkSession, root: str) -> DataFrame:
    """(file, body) of the method text files under root; order by file where order matters."""
    files = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.smali")
    return files.select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("body"))


def parse_smali(files: DataFrame, keys: list[str]) -> DataFrame:
    """one row per method: keys, file, method_ord, class_name, method_name, method_sig, lines, instructions, invokes, strings.

    A method's lines run from its .method to the next .end method; abstract methods have none. Files without a class give no
    row. Lines are split, numbered and grouped as arrays within the file's row, so there is no shuffle.
    """
    lines = F.transform(F.split("body", r"\r?\n"), T.strip)
    named = files.withColumn("_lines", lines).withColumn("_class", F.get(F.filter("_lines", lambda x: x.startswith(".class ")), 0))
    cls = F.regexp_replace(F.element_at(F.split("_class", r"\s+"), -1), r"\AL|;\z", "")
    blocks = F.filter(F.transform(F.slice(F.split("body", r"(?m)^\s*\.method\s+"), 2, 1 << 30), lambda b: F.regexp_extract(b, r"(?s)\A(.*?)(?:\r?\n\s*\.end method|\z)", 1)), lambda b: F.trim(b) != "")
    rows = named.where("_class is not null").select(*keys, "file", cls.alias("class_name"), F.posexplode(blocks).alias("method_ord", "_block"))
    own = F.split("_block", r"\r?\n")
    head = F.element_at(F.split(T.strip(F.element_at(own, 1)), r"\s+"), -1)
    rows = rows.withColumns({"_head": head, "lines": F.slice(own, 2, 1 << 30)})
    rows = rows.withColumns({"method_name": F.regexp_extract("_head", r"\A([^(]+)", 1), "method_sig": F.concat(F.lit("L"), "class_name", F.lit(";->"), "_head"), "instructions": T.instructions(F.col("lines"))})
    rows = rows.withColumns({"invokes": T.invokes(F.col("instructions")), "strings": T.string_literals(F.col("instructions"))})
    return rows.where("method_name <> ''").drop("_block", "_head")


def read_permission_map(spark: SparkSession, path: str) -> DataFrame:
    """(api_sig, perms) out of a mapping text; see permission_map()."""
    return permission_map(spark.read.text(path, wholetext=True).select("value"))


def permission_map(texts: DataFrame, column: str = "value") -> DataFrame:
    """Each `<signature>` line belongs to the permission last named above it; lines without one are dropped, as are those
    under a permission line that names none.

    Only the text up to a line's first > is read, so constructors have no signature.
    """
    numbered = texts.withColumn("doc", F.monotonically_increasing_id())
    lines = numbered.select("doc", F.posexplode(F.split(column, r"\r?\n")).alias("pos", "line"))
    lines = lines.withColumn("line", T.strip(F.col("line")))
    perm = F.when(F.col("line").startswith("Permission:"), T.strip(F.regexp_replace("line", r"\APermission:", "")))
    above = F.last(perm, ignorenulls=True).over(Window.partitionBy("doc").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    sigs = lines.withColumn("perm", above).where("perm <> '' and line like '<%>%'")
    sig = T.smali_signature(F.regexp_extract("line", r"\A(<[^>]*>)", 1))
    return sigs.select(sig.alias("api_sig"), "perm").where("api_sig is not null").groupBy("api_sig").agg(F.array_sort(F.collect_set("perm")).alias("perms"))


def read_manifests(spark: SparkSession, path: str) -> DataFrame:
    """Manifests with sorted distinct lists and components, the union of the four component lists; absent lists are empty."""
    return manifests(spark.read.schema(schemas.MANIFEST).json(path))


def manifests(raw: DataFrame) -> DataFrame:
    names = ["permissions", "activities", "services", "receivers", "providers"]
    lists = {c: F.array_sort(F.array_distinct(F.coalesce(c, F.array().cast("array<string>")))) for c in names}
    out = raw.withColumns(lists | {"package": F.coalesce("package", F.lit(""))})
    return out.withColumn("components", F.array_sort(F.array_distinct(F.concat(*names[1:]))))


def component_roles(manifest: DataFrame, keys: list[str]) -> DataFrame:
    """A2: (keys, class_name, roles): what kinds of component a class is declared as."""
    parts = [manifest.select(*keys, F.explode(c).alias("name"), F.lit(role).alias("role")) for c, role in (("activities", "activity"), ("services", "service"), ("receivers", "receiver"), ("providers", "provider"))]
    rows = parts[0].union(parts[1]).union(parts[2]).union(parts[3])
    return rows.groupBy(*keys, F.translate("name", ".", "/").alias("class_name")).agg(F.array_sort(F.collect_set("role")).alias("roles"))


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """(apk_id, family, behaviors); key apk_id, else sha; of repeated keys the last line holds; broken lines are skipped.

    A .json file is one object of such objects by apk_id. A missing file gives an empty table.
    """
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return labels(spark.createDataFrame([], f"{schemas.LABELS}, _line long"))
    if path.endswith(".json"):
        whole = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,struct<family:string,behaviors:array<string>>>")).alias("apk_id", "x"))
        return labels(whole.select("apk_id", F.lit(None).cast("string").alias("sha"), "x.family", "x.behaviors", F.lit(0).alias("_line")))
    raw = spark.read.schema(f"{schemas.LABELS}, _corrupt string").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    # Within a split of a file the ids rise with the lines; splits are ordered by their file and start.
    at = F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("i"))
    return labels(raw.withColumn("_line", at))


def labels(raw: DataFrame, order: str = "_line") -> DataFrame:
    if "_corrupt" in raw.columns:
        raw = raw.where("_corrupt is null")
    rows = raw.withColumn("apk_id", F.coalesce(F.nullif(F.trim("apk_id"), F.lit("")), F.nullif(F.trim("sha"), F.lit("")))).where("apk_id is not null")
    row = F.max_by(F.struct("family", "behaviors"), order).alias("x")
    return rows.groupBy("apk_id").agg(row).select("apk_id", F.coalesce("x.family", F.lit("unknown")).alias("family"), F.coalesce("x.behaviors", F.array().cast("array<string>")).alias("behaviors"))


def read_methods(spark: SparkSession, path: str) -> DataFrame:
    """Methods with signature and embedding."""
    return spark.read.schema(schemas.METHODS).json(path).where("method_sig is not null and embedding is not null")


def last_methods(methods: DataFrame, order: str) -> DataFrame:
    """Of repeated signatures the last row."""
    keys = [*schemas.APK_KEY, "method_sig"]
    w = Window.partitionBy(*keys).orderBy(F.desc(order))
    return methods.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def read_edges(spark: SparkSession, path: str) -> DataFrame:
    """The bag of calls."""
    return spark.read.schema(schemas.EDGES).json(path)


def read_table(spark: SparkSession, path: str, years=None) -> DataFrame:
    """A table partitioned by year, pruned to the given years."""
    return spark.read.parquet(path).where(in_years(F.col("year"), years))


def select_targets(apks: DataFrame, wanted: DataFrame | None = None, years=None, limit: int = 0) -> DataFrame:
    """Applications named in a list (`year/sha`, `year/sha.apk`, a bare sha or a directory that ends so), else those of the years."""
    if wanted is not None:
        name = F.regexp_replace(T.strip(F.col(wanted.columns[0])), r"(?i)\.apk\z", "")
        parts = wanted.select(F.upper(F.regexp_extract(name, r"([^/\\]+)[/\\]?\z", 1)).alias("apk_sha256"), F.regexp_extract(name, r"(\d{4})[/\\][^/\\]+[/\\]?\z", 1).alias("y")).distinct()
        apks = apks.join(parts, (apks["apk_sha256"] == parts["apk_sha256"]) & ((parts["y"] == "") | (parts["y"] == apks["year"])), "left_semi")
    else:
        apks = apks.where(in_years(F.col("year"), years) & ~F.col("apk_sha256").startswith("_"))
    apks = apks.orderBy("year", "apk_sha256")
    return apks.limit(limit) if limit > 0 else apks


def pair_units(kb: DataFrame, raw: DataFrame) -> DataFrame:
    """Every KB unit with the raw unit of the same key, null where there is none."""
    keys = [*schemas.APK_KEY, "unit_id"]
    return kb.join(raw.select(*keys, F.struct(*[c for c in raw.columns if c not in keys]).alias("raw")), keys, "left")


def valid_json(df: DataFrame, column: str, schema: str, out: str = "parsed") -> DataFrame:
    """Parse a column; rows that are no JSON of the schema give null."""
    return df.withColumn(out, F.from_json(column, schema))


def unit_id(given: Column, path: Column) -> Column:
    """A unit's id: the given one if it isn't blank, else the stem of its file."""
    return F.coalesce(F.nullif(T.strip(given), F.lit("")), F.regexp_extract(path, r"([^/\\]+?)(?:\.[^./\\]*)?$", 1))


def smali_text(text: Column, lines: Column, content: Column, content_lines: Column, *others: Column) -> Column:
    """a node's method text: one string, or lines, or an object's content (a string or lines), or the first of its other texts."""
    return F.coalesce(text, F.array_join(lines, "\n"), content, F.array_join(content_lines, "\n"), *others, F.lit(""))
