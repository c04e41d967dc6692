"""Delimited text: encoding, delimiter, ragged rows, missing-value marks and column types."""

from __future__ import annotations

import re
from collections.abc import Iterator
from contextlib import contextmanager
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.parsing import NULL_MARKERS, as_boolean, as_number, as_plain_time, trimmed
from ..operators.columns import normalised
from ..plans.table import Key, Table, stored
from .records import PLACE, left_open, records

CANDIDATES = (",", ";", "\t", "|")
EXTENSIONS = ("csv", "tsv", "txt", "xlsx")
#: Share of cells that must look like times for a column of times, in percent.
TIME_SHARE = 80


def extension(path: str) -> str:
    ext = path.rsplit(".", 1)[-1].lower() if "." in path.rsplit("/", 1)[-1] else ""
    if ext not in EXTENSIONS:
        raise ValueError(f"{path}: none of {', '.join(EXTENSIONS)}")
    return ext


def header_names(cells: list[str]) -> list[str]:
    """Normalised names, in which dots and backticks, special in Spark's column names, are underscores."""
    return normalised([c.replace(".", "_").replace("`", "_") for c in cells])


_PART = r"/part-([0-9]+)[^/]*$"


def part_number(path: str) -> int:
    """The number in the name of a part file, which has five digits or more; 0 for other files."""
    found = re.search(_PART, path)
    return int(found[1]) if found else 0


def raw_lines(spark: SparkSession, path: str) -> DataFrame:
    """line: each line with one character for each byte, whatever its encoding."""
    return spark.read.schema("line string").option("sep", "\x01").option("quote", "").option("encoding", "ISO-8859-1").csv(path)


def summary(lines: DataFrame) -> tuple[str, dict[str, int], dict[str, bool]]:
    """From one pass over all lines: the encoding (UTF-8 if all are valid, else GBK) and, for each candidate, the most
    cells of a line and whether a line ends within a quoted cell. A byte of a GBK character may look like a candidate, so
    there any quote counts."""
    line = F.col("line")
    valid = F.is_valid_utf8(F.encode(line, "ISO-8859-1").cast("string"))
    widths = [F.max(F.length(line) - F.length(F.translate(line, sep, "")) + 1) for sep in CANDIDATES]
    found = list(lines.agg(F.max(~valid), F.max(line.contains('"')), *widths, *(F.max(left_open(line, sep)) for sep in CANDIDATES)).first())
    n = len(CANDIDATES)
    return "GBK" if found[0] else "UTF-8", {sep: x or 1 for sep, x in zip(CANDIDATES, found[2:], strict=False)}, {sep: bool(found[1] if found[0] else x) for sep, x in zip(CANDIDATES, found[2 + n :], strict=True)}


def delimiter_of(lines: list[str], ext: str) -> str:
    """The most frequent candidate in the first twelve lines that are not blank, of several the last; tab for .tsv."""
    if ext == "tsv":
        return "\t"
    text = "\n".join([x for x in lines if x.strip()][:12])
    return max(reversed(CANDIDATES), key=text.count)


def counters(v: Column) -> Column:
    """Of a text column: how many cells are there, and how many of them are whole numbers, numbers, truth values and
    times. Counters of parts of a table add up."""
    t = trimmed(v)
    tests = (v.isNotNull(), t.rlike(r"^[+-]?[0-9]+$") & t.try_cast("bigint").isNotNull(), as_number(v).isNotNull(), as_boolean(v, False).isNotNull(), as_plain_time(v).isNotNull())
    return F.array(*(F.count_if(F.coalesce(x, F.lit(False))) for x in tests))


def kind_of_cells(counted: list[int]) -> str:
    """Whole numbers, numbers or truth values if all cells are, times if 80 % are, else text."""
    n, whole, number, truth, time = counted
    return "string" if not n else "bigint" if whole == n else "double" if number == n else "boolean" if truth == n else "timestamp_ntz" if 100 * time // n >= TIME_SHARE else "string"


def infer(df: DataFrame, names: list[str]) -> dict[str, str]:
    """The type of each text column, from one pass over all its cells."""
    row = df.agg(*(counters(F.col(c)).alias(f"a{i}") for i, c in enumerate(names))).first()
    return {c: kind_of_cells(row[f"a{i}"]) for i, c in enumerate(names)}


def typed(df: DataFrame, types: dict[str, str]) -> DataFrame:
    def cast(c: str, kind: str):
        v = F.col(c)
        return {"bigint": lambda: trimmed(v).try_cast("bigint"), "double": lambda: as_number(v), "boolean": lambda: as_boolean(v, False), "timestamp_ntz": lambda: as_plain_time(v)}.get(kind, lambda: v)()

    return df.withColumns({c: cast(c, k) for c, k in types.items() if k != "string"})


@contextmanager
def charsets(spark: SparkSession, encoding: str) -> Iterator[None]:
    """Lets Spark read GBK, which it knows only with these settings (the second marks bytes that are no character instead
    of ending the job), and puts them back."""
    names = ("spark.sql.legacy.javaCharsets", "spark.sql.legacy.codingErrorAction")
    before = {name: spark.conf.get(name) for name in names}
    try:
        for name in names if encoding == "GBK" else ():
            spark.conf.set(name, "true")
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def _place() -> dict[str, Column]:
    """The columns that rows of files are ordered by, but for the row's place in its split."""
    file = F.col("_metadata.file_path")
    number = F.coalesce(F.regexp_extract(file, _PART, 1).try_cast("long"), F.lit(0).cast("long"))
    return {"__o0": number, "__o1": file, "__o2": F.col("_metadata.file_block_start")}


def _raw(width: int) -> T.StructType:
    return T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(width)])


def _by_line(spark: SparkSession, files: list[str], width: int, options: dict) -> tuple[list, DataFrame]:
    """The header, the first row of the first file that has one, and the other rows, where each line is a row."""
    raw, place = _raw(width), [c.alias(n) for n, c in _place().items()]
    for at, file in enumerate(files):
        first = spark.read.schema(raw).options(**options).csv(file).head(1)
        if first:
            break
    else:
        raise ValueError("no rows")
    reader = lambda head: spark.read.schema(raw).options(**options, header=head, enforceSchema=True)
    df = reader(True).csv(files[at]).select(*raw.names, *place)
    if files[at + 1 :]:  # parts after the first have no header
        df = df.unionByName(reader(False).csv(files[at + 1 :]).select(*raw.names, *place))
    return list(first[0]), df.withColumn("__o3", F.monotonically_increasing_id())


def _by_record(spark: SparkSession, path: str, options: dict) -> tuple[list, DataFrame]:
    """The same where cells go on in the next line: records are found in all splits at once, then read as rows. Line
    breaks within cells are \n, however the file ends its lines."""
    sep, gbk = options["sep"], options["encoding"] == "GBK"
    value = F.decode(F.col("value").cast("binary"), "GBK") if gbk else F.col("value")
    lines = spark.read.text(path).select(*(c.alias(n) for n, c in _place().items()), F.monotonically_increasing_id().alias("__o3"), value.alias("line"))
    rows = records(lines, sep).filter(F.trim("line") != "")
    place = F.struct(*PLACE)
    cells = F.max(F.length("line") - F.length(F.translate("line", sep, "")) + 1).alias("width")
    found = rows.agg(F.min(place).alias("place"), F.min_by("line", place).alias("line"), cells).first()
    if found.line is None:
        raise ValueError("no rows")
    raw = _raw(found.width)
    parsed = F.from_csv("line", F.lit(raw.simpleString()[len("struct<") : -1].replace(":", " ")), {k: str(v) for k, v in options.items() if k != "encoding"})
    header = spark.createDataFrame([(found.line,)], "line string").select(parsed.alias("r")).select("r.*").first()
    rest = rows.filter(place != F.struct(*(F.lit(v).alias(n) for n, v in found.place.asDict().items())))
    return list(header), rest.select(parsed.alias("r"), *PLACE).select("r.*", *PLACE)


def read_delimited(spark: SparkSession, path: str, keep_text: bool = False) -> Table:
    """A file, or a folder of part files in the order of their numbers and names, of which the first begins with a header row.
    Short rows get nulls, long ones further columns; cells are trimmed, and those that mark a missing value are null.
    With keep_text, columns stay text. Files are split, those with cells over several lines too. The cells of such
    files and of GBK are stored once, other text is read when it is needed."""
    lines = raw_lines(spark, path)
    encoding, widths, opened = summary(lines)
    head = [x.line.encode("latin-1").decode(encoding, "replace") for x in lines.filter("line is not null").head(50)]
    sep = delimiter_of(head, extension(path))
    files = sorted((unquote(f) for f in lines.inputFiles()), key=lambda f: (part_number(f), f))
    options = {"sep": sep, "encoding": encoding, "mode": "PERMISSIVE", "escape": '"', "ignoreLeadingWhiteSpace": True, "ignoreTrailingWhiteSpace": True}
    with charsets(spark, encoding):
        try:
            header, df = _by_record(spark, path, options) if opened[sep] else _by_line(spark, files, widths[sep], options)
        except ValueError as e:
            raise ValueError(f"{path}: {e}") from e
        if encoding == "GBK" or opened[sep]:
            df = stored(df, "cells")
    cells = [c for c in df.columns if not c.startswith("__")]
    marked = {c: F.when(~trimmed(F.col(c)).isin(*NULL_MARKERS), trimmed(F.col(c))) for c in cells}
    # One more pass tells which columns hold anything and of what type.
    seen = df.agg(*(F.struct(F.count(c).alias("n"), (F.lit(None) if keep_text else counters(marked[c])).alias("of")).alias(c) for c in cells)).first()
    used = max([i + 1 for i, x in enumerate(header) if x is not None], default=1)
    width = max([used, *(i + 1 for i, x in enumerate(seen) if x["n"])])  # separators within quotes made it too large
    names = header_names([(header[i] or "").lstrip("\ufeff") for i in range(used)] + [""] * (width - used))
    df = df.select(*(marked[f"c{i}"].alias(n) for i, n in enumerate(names)), "__o0", "__o1", "__o2", "__o3")
    if not keep_text:
        df = typed(df, {n: kind_of_cells(seen[i]["of"]) for i, n in enumerate(names)})
    return Table(df, tuple(Key(f"__o{i}") for i in range(4)))


def load_paths(spark: SparkSession, paths: list[str]) -> dict[str, Table]:
    """Tables by name: the file's, with [sheet] after it for the sheets of a workbook with several. It is an error, which
    names them all, if files cannot be read: no table is left out without a word."""
    from .workbook import read_workbook

    out: dict[str, Table] = {}
    errors = []
    for path in paths:
        stem = path.rsplit("/", 1)[-1].rsplit(".", 1)[0]
        try:
            if extension(path) == "xlsx":
                sheets = read_workbook(spark, path)
                out |= {stem if len(sheets) == 1 else f"{stem}[{name}]": t for name, t in sheets.items()}
            else:
                out[stem] = read_delimited(spark, path)
        except (ValueError, AnalysisException) as e:
            errors.append(f"{path}: {e}")
    if errors or not out:
        raise ValueError("; ".join(errors) or "no file to read")
    return out
