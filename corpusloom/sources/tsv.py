"""Tab-separated scans in three modes, small text sources, and the sinks of a release."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from corpusloom.functions.expr import LAST_NUMBER, NA_WORDS, replace_all, strip, to_number
from corpusloom.operators.relational import with_position
from corpusloom.operators.selection import latest_per_key

MODES = ("inferred", "strings", "filled")
_OPTIONS = {"sep": "\t", "quote": '"', "escape": '"', "emptyValue": "", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}


def first_lines(spark: SparkSession, paths: str | list[str]) -> dict[str, str | None]:
    """The first line of each file of the paths, folders or patterns, None for an empty file.

    Only the beginning of a file is read, by the driver; gzip by suffix.
    """
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    codecs = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf)
    found = {}
    for name in sorted(spark.read.text(paths).inputFiles()):
        path = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(name))
        stream = path.getFileSystem(conf).open(path)
        codec = codecs.getCodec(path)
        reader = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(codec.createInputStream(stream) if codec else stream, "UTF-8"))
        try:
            found[name] = reader.readLine()
        finally:
            reader.close()
    return found


def _names(line: str, sep: str) -> list[str]:
    return [x[1:-1].replace('""', '"') if len(x) > 1 and x[0] == x[-1] == '"' else x for x in line.lstrip("\ufeff").split(sep)]


def header_of(spark: SparkSession, path: str, sep: str = "\t") -> list[str]:
    """Column names in the first line of the first file that has one."""
    return next((_names(line, sep) for line in first_lines(spark, path).values() if line is not None), [])


def read_tsv(spark: SparkSession, path: str | list[str], mode: str, types: dict[str, str] | None = None, columns: list[str] | None = None, sep: str = "\t", multiline: bool = False) -> DataFrame:
    """Scan of one or more files, folders or patterns; gzip by suffix; missing trailing fields are empty.

    ``strings`` keeps every field as text and empty fields as ``""``; ``filled`` turns the
    missing-value words into ``""``; ``inferred`` turns them into null and casts the
    columns named in ``types`` (never ids: ``001`` stays). Without ``columns`` the first
    line of each file is its header: files are united by the names of their columns, in the
    order of the first file, and a column that a file lacks is missing in its rows. Empty
    files have no rows. ``multiline`` reads quoted line breaks, one task per file.
    """
    if mode not in MODES:
        raise ValueError(f"mode is one of {MODES}")
    types = types or {}

    def scan(paths: list[str], names: list[str]) -> DataFrame:
        schema = StructType([StructField(n, StringType()) for n in names])
        options = {"sep": sep, "header": str(columns is None).lower(), "multiLine": str(multiline).lower(), "enforceSchema": "true"}
        df = spark.read.options(**_OPTIONS).options(**options).schema(schema).csv(paths).na.fill("")
        missing = lambda c: F.col(f"`{c}`").isin(*NA_WORDS)
        if mode == "filled":
            return df.select(*[F.when(missing(c), "").otherwise(F.col(f"`{c}`")).alias(c) for c in names])
        if mode == "inferred":
            return df.select(*[F.when(~missing(c), F.col(f"`{c}`").try_cast(types.get(c, "string"))).alias(c) for c in names])
        return df

    paths = [path] if isinstance(path, str) else path
    if columns:
        return scan(paths, columns)
    by_header: dict[tuple[str, ...], list[str]] = {}
    for name, line in first_lines(spark, paths).items():
        if line is not None:
            by_header.setdefault(tuple(_names(line, sep)), []).append(name)
    if not by_header:
        return spark.createDataFrame([], StructType([]))
    for names in by_header:
        if len(set(names)) < len(names):
            raise ValueError(f"a column stands twice in the header {list(names)}")
    if len(by_header) == 1:
        return scan(paths, list(next(iter(by_header))))
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [scan(files, list(names)) for names, files in by_header.items()])
    return every if mode == "inferred" else every.na.fill("")


def read_shards(spark: SparkSession, pattern: str, header: list[str] | None = None, multiline: bool = False) -> DataFrame:
    """All shard files of a pattern; a file with another header is an error, an empty one is skipped.

    Without ``header`` that of the first file is the right one.
    """
    lines = {name: _names(line, "\t") for name, line in first_lines(spark, pattern).items() if line is not None}
    if not lines:
        raise ValueError(f"no shard has a header: {pattern}")
    right = header or next(iter(lines.values()))
    for name, names in lines.items():
        if names != right:
            raise ValueError(f"{name} has the header {names}, not {right}")
    return read_tsv(spark, list(lines), "strings", multiline=multiline)


def read_pairs(spark: SparkSession, path: str, multiline: bool = False) -> DataFrame:
    """(id, source, target, output); a file of the three older columns gets its row number as id.

    Names are compared without case and outer blanks; further columns are left out, other
    headers are an error.
    """
    header = header_of(spark, path)
    plain = [h.strip().lower() for h in header]
    wanted = ["id", "source", "target", "output"]
    first = 4 if plain[:4] == wanted else 3 if plain[:3] == wanted[1:] else 0
    if not first:
        raise ValueError(f"expected the columns {wanted} or {wanted[1:]}, got {header}")
    df = read_tsv(spark, path, "strings", multiline=multiline).select(*[F.col(f"`{c}`").alias(n) for c, n in zip(header[:first], wanted[-first:])])
    if first == 4:
        return df
    placed = with_position(df.withColumn("_line", F.monotonically_increasing_id()), ["_line"])
    return placed.select(F.col("position").cast("string").alias("id"), "source", "target", "output")


def read_numbers(spark: SparkSession, path: str) -> DataFrame:
    """The last number of each line that has one."""
    found = F.regexp_extract_all("value", F.lit(LAST_NUMBER), F.lit(0))
    return spark.read.text(path).select(F.when(F.size(found) > 0, F.element_at(found, -1)).cast("double").alias("value")).filter("value is not null")


def read_line_set(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(strip(F.col("value")).alias("value")).filter("value <> ''").distinct()


def read_cache(spark: SparkSession, path: str, key: str, value: str, number: bool = False) -> DataFrame:
    """(key, value) of a cache file: empty keys and unreadable numbers are skipped, the last row wins."""
    if not {key, value} <= set(header_of(spark, path)):
        return spark.createDataFrame([], f"`{key}` string, `{value}` {'double' if number else 'string'}")
    df = read_tsv(spark, path, "strings").select(key, (to_number(F.col(value)) if number else F.col(value)).alias(value), F.input_file_name().alias("_file"), F.monotonically_increasing_id().alias("_line"))
    kept = df.filter((F.col(key) != "") & F.col(value).isNotNull())
    return latest_per_key(kept, [key], ["_file", "_line"]).select(key, value)


def read_summary(spark: SparkSession, path: str) -> dict:
    """A JSON summary, or nothing where there is no file."""
    if not exists(spark, path):
        return {}
    return json.loads("\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect()))


def read_config(spark: SparkSession, path: str, required: tuple[str, ...] = ()) -> dict:
    """Settings of a JSON or YAML file (YAML only where the library for it is installed); missing ones are an error."""
    text = "\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect())
    if path.endswith((".yaml", ".yml")):
        try:
            import yaml
        except ModuleNotFoundError as e:
            raise ValueError("reading YAML needs the yaml library") from e
        found = yaml.safe_load(text) or {}
    else:
        found = json.loads(text)
    if missing := [k for k in required if found.get(k) in (None, "")]:
        raise ValueError(f"settings missing in {path}: {missing}")
    return found


# Sinks ----------------------------------------------------------------------------------


def write_tsv(df: DataFrame, path: str, header: bool = True, compression: str = "none", single: bool = False, mode: str = "errorifexists", sep: str = "\t") -> None:
    """Tab-separated files; ``single`` writes one file, for small exports only."""
    out = df.coalesce(1) if single else df
    out.write.options(**_OPTIONS).option("sep", sep).option("header", str(header).lower()).option("compression", compression).option("escapeQuotes", "true").mode(mode).csv(path)


def append_tsv(df: DataFrame, path: str) -> None:
    """Further files in a folder of TSV files; each has its header, which a scan skips, so rows have one header in effect.

    The columns must be those of the files there.
    """
    spark = df.sparkSession
    try:
        before = header_of(spark, path)
    except AnalysisException:
        before = []
    if before and before != df.columns:
        raise ValueError(f"{path} has the columns {before}, not {df.columns}")
    write_tsv(df, path, mode="append")


def copied(df: DataFrame, patterns: dict[str, str], path: str, compression: str = "none") -> int:
    """Copy of lines of text (``value``) with literal replacements; returns their number."""
    rewrite_text(df.select("value"), ["value"], patterns).write.option("compression", compression).text(path)
    return df.sparkSession.read.text(path).count()


def joined_texts(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Text parts in order as (part, line, value): each part begins on a line of its own, whether or not the one before ended its last.

    A missing or empty part is skipped.
    """
    existing = [(k, p) for k, p in enumerate(paths) if exists(spark, p)]
    parts = [spark.read.text(p).select(F.lit(k).alias("part"), F.monotonically_increasing_id().alias("line"), "value") for k, p in existing]
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], "part int, line bigint, value string")


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def files_in(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, modified) of the files below a folder, without empty ones; their content isn't read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", F.col("modificationTime").alias("modified"))


def write_ids(df: DataFrame, id_col: str, path: str) -> None:
    df.select(F.col(id_col).cast("string")).write.text(path)


def write_summary(summary: dict, spark: SparkSession, path: str) -> None:
    """A JSON file, and beside it a TSV of one row."""
    spark.createDataFrame([(json.dumps(summary, ensure_ascii=False, indent=2, sort_keys=True),)], "value string").coalesce(1).write.text(path)
    row = [tuple("" if v is None else str(v) for v in summary.values())]
    if summary:
        write_tsv(spark.createDataFrame(row, ", ".join(f"`{k}` string" for k in summary)), f"{path}.tsv", single=True)


def rewrite_text(df: DataFrame, columns: list[str], patterns: dict[str, str]) -> DataFrame:
    """Release copy: literal replacements, the longest first, in the text columns."""
    return df.withColumns({c: replace_all(F.col(c), patterns) for c in columns})


def rewrite_tree(x, patterns: dict[str, str]):
    """The same in a JSON tree, keys included."""
    if isinstance(x, dict):
        return {rewrite_tree(k, patterns): rewrite_tree(v, patterns) for k, v in x.items()}
    if isinstance(x, list):
        return [rewrite_tree(v, patterns) for v in x]
    if isinstance(x, str):
        for k, v in sorted(patterns.items(), key=lambda kv: (-len(kv[0]), kv[0])):
            x = x.replace(k, v)
    return x


#: The fields of a release inventory, in order.
INVENTORY_FIELDS = ("language_pair", "stage", "source_path", "release_path", "kind", "required", "status", "rows_or_items", "bytes", "note")


def inventory(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """Inventory rows in the fixed field order; what is missing is empty."""
    values = [tuple("" if r.get(f) is None else str(r[f]) for f in INVENTORY_FIELDS) for r in rows]
    return spark.createDataFrame(values, ", ".join(f"{f} string" for f in INVENTORY_FIELDS))
