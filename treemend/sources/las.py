"""LAS 2.0 log files as DataFrames.

Files become lines (file, section, line_no, line). Small files are read whole,
once, many to a task. Large ones are read in parallel splits: a first pass over
the splits yields a few numbers for each; with those of the splits before it,
each split tells its lines their section and number, so no line is sorted or
shuffled.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from treemend.functions.values import to_number
from treemend.model import NULL_CURVE, NULL_NUMBER, UNKNOWN
from treemend.scale import broadcast_if_small, pin_splits
from treemend.session import cut_lineage

# Header mnemonics and well columns, key fallbacks, defaults, value limit.
WELL_MAPPING = {
    "UWI": "UWI",
    "LAT": "SURFACE_LATITUDE",
    "LON": "SURFACE_LONGITUDE",
    "COMP": "OPERATOR",
    "WELL": "WELL_NAME",
    "LEAS": "LEASE_NAME",
}
ALTERNATIVE_KEYS = (("API",), ("LEAS", "WELL"))
UNKNOWN_DEFAULTS = ("ASSIGNED_FIELD", "OPERATOR", "DEPTH_DATUM", "CURRENT_STATUS")
SECTIONS = ("V", "W", "C", "P", "A")
VALUE_LIMIT = 999999999999999.0
# Bytes up to which a file is read whole: opening it costs more than reading it.
WHOLE_BYTES = 4 << 20
# Endings of files that only the reader of splits unpacks.
PACKED = r"\.(gz|gzip|bz2|deflate|snappy|lz4|zst|passthrough)$"
# Spark counts opening a file as reading 4 MB, so 32 small files make a part; a task takes as many parts.
PARTS_PER_TASK = 32


def _carries(raw: DataFrame) -> DataFrame:
    """Per split of a file: where its lines begin, and the sections of the file.

    (file, start, _first, _lines, _before, _sections): the number of the
    split's first row, its lines, the file's lines before it, and per section
    letter (letter, line, piece, upto): the line that opens it, which ``~`` of
    that line does, and the line with the next ``~``. The last of a letter
    counts. The lines are read and not kept: a task gives a row per split, with
    the few lines that hold a ``~``.
    """
    marked = F.when(F.col("value").contains("~"), F.struct("at", "value"))
    splits = cut_lineage(raw.groupBy("file", "start").agg(F.min("at").alias("_first"), F.count(F.lit(1)).alias("_lines"), F.collect_list(marked).alias("_marks")))
    earlier = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumn("_before", F.coalesce(F.sum("_lines").over(earlier), F.lit(0)))
    marks = splits.select("file", "_first", "_before", F.explode("_marks").alias("_m"))
    marks = marks.select("file", (F.col("_before") + F.col("_m.at") - F.col("_first")).alias("line"), F.posexplode(F.split("_m.value", "~")).alias("piece", "text")).filter("piece > 0")
    upto = F.lead("line").over(Window.partitionBy("file").orderBy("line", "piece"))
    opened = marks.select("file", F.substring("text", 1, 1).alias("letter"), "line", "piece", upto.alias("upto")).filter(F.col("letter").isin(*SECTIONS))
    last = opened.groupBy("file", "letter").agg(F.max(F.struct("line", "piece", "upto")).alias("_l"))
    sections = last.groupBy("file").agg(F.collect_list(F.struct("letter", "_l.line", "_l.piece", "_l.upto")).alias("_sections"))
    return cut_lineage(splits.drop("_marks").join(sections, "file", "left"))


def _sections(raw: DataFrame) -> DataFrame:
    """Lines (file, start, at, value) with the section they stand in and their number there; ``~`` opens one wherever it is.

    Lines stay where they are read: what a split has to know of the file comes
    from ``_carries``. A file is read twice; should its splits differ the second
    time, the job fails.
    """
    known = raw.join(broadcast_if_small(_carries(raw)), ["file", "start"], "left")
    own = F.col("at") - F.col("_first")
    changed = F.raise_error(F.lit("the splits of a file changed while it was read")).cast("long")
    line = F.when((own >= 0) & (own < F.col("_lines")), F.col("_before") + own).otherwise(changed)
    pieces = F.when(
        F.col("value").contains("~"),
        F.filter(F.transform(F.split("value", "~"), lambda t, i: F.struct(i.alias("piece"), t.alias("text"))), lambda x: (x["piece"] > 0) | (x["text"] != "")),
    ).otherwise(F.array(F.struct(F.lit(0).alias("piece"), F.col("value").alias("text"))))
    rows = known.select("file", "_sections", line.alias("_line"), F.inline(pieces))
    opens = lambda s: (s["line"] == F.col("_line")) & (s["piece"] == F.col("piece"))
    holds = lambda s: (F.col("piece") == 0) & (s["line"] < F.col("_line")) & (s["upto"].isNull() | (F.col("_line") <= s["upto"]))
    rows = rows.withColumn("_s", F.get(F.filter("_sections", lambda s: opens(s) | holds(s)), 0)).filter(F.col("_s").isNotNull())
    return rows.select("file", F.col("_s.letter").alias("section"), (F.col("_line") - F.col("_s.line")).alias("line_no"), F.col("text").alias("line"))


def _file_sections(content: bytes) -> dict[bytes, list[bytes]]:
    """The lines of each section of one file, by the rules of ``_sections``; a line's number is its place."""
    lines, found = [], {}
    for value in content.removeprefix(b"\xef\xbb\xbf").splitlines():
        if b"~" not in value:
            lines.append(value)
            continue
        before, *opened = value.decode("utf-8", "replace").encode().split(b"~")
        if before:
            lines.append(before)
        for text in opened:
            lines = [text]
            if text[:1] in _LETTERS:
                # the last of a letter counts
                found[text[:1]] = lines
    return found


_LETTERS = frozenset(s.encode() for s in SECTIONS)


def _whole_files(batches):
    """(file, content) -> (file, lines), a row per file."""

    def texts(ends, data):
        # bytes that are no UTF-8 stay as they are, as in lines read by splits
        return pa.StringArray.from_buffers(len(ends) - 1, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data))

    for batch in batches:
        letters, counts, lines, ends = [], [], [], [0]
        for content in batch.column(1):
            for letter, rows in _file_sections(content.as_py()).items():
                letters.append(letter)
                counts.append(len(rows))
                lines += rows
            ends.append(len(lines))
        sizes = np.array(counts, np.int64)
        first = np.repeat(np.cumsum(sizes) - sizes, sizes)
        section = np.repeat(np.frombuffer(b"".join(letters), np.uint8), sizes)
        at = np.arange(len(lines) + 1)
        line = texts(np.cumsum(np.fromiter((0, *map(len, lines)), np.int64)), b"".join(lines))
        rows = pa.StructArray.from_arrays([texts(at, section.tobytes()), pa.array(at[:-1] - first), line], ["section", "line_no", "line"])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), rows)], names=["file", "lines"])


def _listing(spark: SparkSession, path: str) -> DataFrame:
    """The files below a path, unread; filters on their size and name are settled by the listing."""
    pin_splits(spark)
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)


def _many_to_a_task(files: DataFrame) -> DataFrame:
    """The same files, in tasks of about a thousand small ones."""
    parts = files.rdd.getNumPartitions()
    return files.coalesce(max(files.sparkSession.sparkContext.defaultParallelism, parts // PARTS_PER_TASK))


def _scan(files: DataFrame, path: str) -> DataFrame:
    """Lines of the listed files, see ``scan_las``."""
    whole = (F.col("_metadata.file_size") <= WHOLE_BYTES) & ~F.lower("_metadata.file_name").rlike(PACKED)
    small = _many_to_a_task(files.where(whole)).select(F.col("_metadata.file_path").alias("file"), "content")
    lines = cut_lineage(small.mapInArrow(_whole_files, "file string, lines array<struct<section: string, line_no: bigint, line: string>>").selectExpr("file", "inline(lines)"))
    if files.where(~whole).isEmpty():
        return lines
    rows = files.sparkSession.read.option("recursiveFileLookup", "true").text(path).where(~whole)
    return lines.unionByName(_sections(rows.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("at"), "value",
    )))


def scan_las(spark: SparkSession, path: str) -> DataFrame:
    """(file, section, line_no, line) of all LAS files below a path.

    Small files are read whole and their lines written once, as opening a file
    again costs more. Others are read line by line in splits, whatever their
    size. A line ends with CR, LF or both, and blank lines are lines, also at
    the end of a file.
    """
    return _scan(_listing(spark, path), path)


def header_lines(lines: DataFrame) -> DataFrame:
    """Header lines as (mnemonic, unit, data, description).

    Mnemonic to the first dot, unit to the first blank, data to the last
    colon; comments and lines without a dot are skipped.
    """
    rows = lines.filter((F.col("section") != "A") & ~F.col("line").startswith("#") & (F.instr("line", ".") > 1))
    rest = F.substr(F.col("line"), F.instr("line", ".") + 1)
    rows = rows.withColumn("_rest", rest).withColumn("_blank", F.instr("_rest", " "))
    unit = F.when(F.col("_blank") > 1, F.substr(F.col("_rest"), F.lit(1), F.col("_blank") - 1)).otherwise("")
    rows = rows.withColumn("unit", unit).withColumn(
        "_rest", F.when(F.col("_blank") > 1, F.substr(F.col("_rest"), F.col("_blank"))).otherwise(F.col("_rest"))
    )
    colon = F.col("_rest").rlike("^.+:")
    return rows.select(
        "file", "section", "line_no",
        F.trim(F.substring_index("line", ".", 1)).alias("mnemonic"),
        "unit",
        F.when(colon, F.trim(F.regexp_extract("_rest", "^(.+):", 1))).otherwise("").alias("data"),
        F.trim(F.when(colon, F.substring_index("_rest", ":", -1)).otherwise(F.col("_rest"))).alias("description"),
    ).filter(F.length("mnemonic") > 0)


def verdicts(files: DataFrame, headers: DataFrame) -> DataFrame:
    """(file, reason) per file; a null reason means the file is accepted."""
    version = headers.filter(F.col("section") == "V")
    bad_version = (F.col("mnemonic") == "VERS") & ~F.col("data").startswith("2.0")
    bad_wrap = (F.col("mnemonic") == "WRAP") & (F.col("data") != "NO")
    seen = version.groupBy("file").agg(
        F.min(F.when(bad_version, F.struct("line_no", F.lit("version not supported").alias("why")))
              .when(bad_wrap, F.struct("line_no", F.lit("wrap not supported").alias("why")))).alias("_bad"),
        F.max(F.col("mnemonic") == "VERS").alias("_has"),
    )
    why = F.coalesce(F.col("_bad.why"), F.when(~F.coalesce("_has", F.lit(False)), "version missing"))
    return files.join(seen, "file", "left").select("file", why.alias("reason"))


@dataclass
class LasBatch:
    """LAS files with their small parts at hand.

    ``files`` is their listing, for those without a line. ``headers`` (all
    files) is written once; ``lines`` of small files are written too, those of
    large ones are read again, so the data section costs one pass when it is used.
    """

    files: DataFrame
    lines: DataFrame
    headers: DataFrame

    @property
    def verdict(self) -> DataFrame:
        """(file, reason) of every file; a null reason means it is accepted."""
        return verdicts(_many_to_a_task(self.files).select(F.col("_metadata.file_path").alias("file")), self.headers)

    def _accepted(self, df: DataFrame) -> DataFrame:
        judged = verdicts(self.headers.select("file").distinct(), self.headers)
        return df.join(judged.filter(F.col("reason").isNull()).select("file"), "file", "left_semi")

    @property
    def rejects(self) -> DataFrame:
        return self.verdict.filter(F.col("reason").isNotNull())

    @property
    def good_headers(self) -> DataFrame:
        return self._accepted(self.headers)

    def wells(self, **options) -> DataFrame:
        return las_wells(self.good_headers, **options)

    def logs(self, **options) -> DataFrame:
        return las_logs(self.good_headers, self.wells(), **options)

    def values(self, **options) -> DataFrame:
        data = self.lines.filter(F.col("section") == "A")
        return las_values(data, self.good_headers, self.wells(), **options)

    def parameters(self) -> DataFrame:
        return las_parameters(self.good_headers, self.wells())

    def tables(self) -> dict[str, DataFrame]:
        """Wells, curves and samples of the accepted files under their table and column names."""
        upper = lambda df: df.select(*[F.col(c).alias(c.upper()) for c in df.columns])
        return {"WELL": self.wells().drop("file"), "WELL_LOG_CURVE": upper(self.logs()), "WELL_LOG_CURVE_VALUE": upper(self.values())}


def load_las(spark: SparkSession, path: str) -> LasBatch:
    """The LAS files below a path; their headers are read at once."""
    files = _listing(spark, path)
    lines = _scan(files, path)
    return LasBatch(files, lines, cut_lineage(header_lines(lines)))


def las_wells(
    headers: DataFrame,
    mapping: Mapping[str, str] = WELL_MAPPING,
    alternatives: Sequence[Sequence[str]] = ALTERNATIVE_KEYS,
    lengths: Mapping[str, int] | None = None,
) -> DataFrame:
    """One well row per file; the last line of a mnemonic wins.

    When the key is empty the fallbacks are tried in turn. In a fallback of
    several mnemonics the last filled one is taken, with a dash in front if an
    earlier one is filled too.
    """
    wells = headers.filter(F.col("section") == "W")

    def last(name: str) -> Column:
        here = F.col("mnemonic") == name
        return F.max_by(F.when(here, F.col("data")), F.when(here, F.col("line_no")))

    def first(name: str) -> Column:
        here = F.col("mnemonic") == name
        return F.coalesce(F.min_by(F.when(here, F.col("data")), F.when(here, F.col("line_no"))), F.lit(""))

    names = [m for keys in alternatives for m in keys]
    found = wells.groupBy("file").agg(
        *[last(m).alias(c) for m, c in mapping.items()], *[first(m).alias(f"_f_{m}") for m in dict.fromkeys(names)]
    )
    filled = lambda c: F.length(c) > 0
    key = F.coalesce(F.col("UWI"), F.lit(""))
    for keys in alternatives:
        value = F.lit("")
        for i, m in enumerate(keys):
            earlier = reduce(lambda a, b: a | b, [filled(F.col(f"_f_{e}")) for e in keys[:i]], F.lit(False))
            own = F.concat(F.when(earlier, "-").otherwise(""), F.col(f"_f_{m}"))
            value = F.when(filled(F.col(f"_f_{m}")), own).otherwise(value)
        key = F.when(filled(key), key).otherwise(value)
    out = {c: F.coalesce(F.col(c), F.lit(UNKNOWN if c in UNKNOWN_DEFAULTS else "")) for c in mapping.values()}
    out["UWI"] = key
    for c in UNKNOWN_DEFAULTS:
        out.setdefault(c, F.lit(UNKNOWN))
    for c, n in (lengths or {}).items():
        if c in out:
            out[c] = F.substring(out[c], 1, n)
    return found.select("file", *[v.alias(c) for c, v in out.items()])


def curve_names(headers: DataFrame) -> DataFrame:
    """(file, ordinal, curve_id, description): curves in file order, 0 is the depth index."""
    curves = headers.filter(F.col("section") == "C")
    order = Window.partitionBy("file").orderBy("line_no")
    again = Window.partitionBy("file", "mnemonic").orderBy("line_no")
    return curves.select(
        "file", (F.row_number().over(order) - 1).alias("ordinal"), F.col("mnemonic").alias("curve_id"), "unit", "description",
        F.row_number().over(again).alias("_nth"),
    )


def las_logs(headers: DataFrame, wells: DataFrame, null_value: float = NULL_CURVE, source: str | None = None) -> DataFrame:
    """One log row per curve except the depth index; a repeated name counts once."""
    logs = curve_names(headers).filter((F.col("ordinal") >= 1) & (F.col("_nth") == 1)).join(wells.select("file", "UWI"), "file")
    file_name = F.substring_index("file", "/", -1)
    return logs.select(
        F.col("UWI").alias("uwi"), "curve_id", F.lit(null_value).alias("null_representation"),
        F.lit(NULL_NUMBER).alias("value_count"), F.lit(NULL_NUMBER).alias("max_index"), F.lit(NULL_NUMBER).alias("min_index"),
        F.col("description").alias("reported_desc"), (F.lit(source) if source else file_name).alias("source"),
    )


def las_values(lines: DataFrame, headers: DataFrame, wells: DataFrame, null_value: float = NULL_CURVE) -> DataFrame:
    """(uwi, curve_id, sample_id, index_value, measured_value).

    A token that is no number becomes -999.25, a huge value the curve null; a
    short line repeats its last token for the missing columns.
    """
    names = curve_names(headers).groupBy("file").agg(
        F.count(F.lit(1)).alias("n"),
        F.array_sort(F.collect_list(F.when((F.col("ordinal") >= 1) & (F.col("_nth") == 1), F.struct("ordinal", "curve_id")))).alias("curves"),
    )
    # one row per file: its curve list and key
    files = names.join(wells.select("file", "UWI"), "file")
    data = lines.filter((F.col("section") == "A") & (F.col("line_no") >= 1))
    text = F.regexp_replace("line", r"^\s+|\s+$", "")
    files = broadcast_if_small(cut_lineage(files))
    rows = data.select("file", (F.col("line_no") - 1).alias("sample_id"), F.split(text, r" \s*").alias("_tok")).join(files, "file")
    number = lambda token: F.coalesce(to_number(token), F.lit(NULL_CURVE))
    rows = rows.select(
        F.col("UWI").alias("uwi"), "sample_id", number(F.element_at("_tok", 1)).alias("index_value"), "_tok", F.explode("curves").alias("_c")
    )
    at = F.least(F.col("_c.ordinal") + 1, F.size("_tok"))
    measured = number(F.element_at("_tok", at))
    huge = (measured < -VALUE_LIMIT) | (measured > VALUE_LIMIT)
    return rows.select(
        "uwi", F.col("_c.curve_id").alias("curve_id"), F.col("sample_id").cast("bigint").alias("sample_id"), "index_value",
        F.when(huge, F.lit(null_value)).otherwise(measured).alias("measured_value"),
    )


def las_parameters(headers: DataFrame, wells: DataFrame) -> DataFrame:
    """(uwi, seq_no, mnemonic, text_value, description), numbered from 1 per file."""
    rows = headers.filter(F.col("section") == "P").join(wells.select("file", "UWI"), "file")
    order = Window.partitionBy("file").orderBy("line_no")
    return rows.select(
        F.col("UWI").alias("uwi"), F.row_number().over(order).cast("int").alias("seq_no"), "mnemonic",
        F.col("data").alias("text_value"), "description",
    )
