"""Records of one large JSON document, read by many tasks.

Spark's text source splits a file by bytes wherever a line may end. With a closing brace as
the line separator a document of one line is split too, into pieces that lie between two
braces. Whether a piece begins inside a string, and how deep in the document, is what all
pieces before it add up to: a prefix sum over the counts of quotes gives the one, then a
prefix sum over the brackets outside strings the other. A record ends with the brace that
leads back from the third level to the second, so its pieces are those with the same number
of such ends before them; they are put together and parsed where they are.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from skytriage.operators.scan import prefix_scan, with_blocks
from skytriage.session import durable

_TOKEN = re.compile(r'"(?:\\.|[^"\\])*(?:"|$)|[{\[\]]', re.DOTALL)
_NAME = re.compile(r"\s*:\s*$")


def landmarks(value: str, inside: bool, depth: int) -> tuple[int | None, list[str | None]]:
    """(offset of the brace that opens a record, the second-level values that open: names of arrays, null for others).

    ``inside`` says whether the piece begins in a string, ``depth`` how many brackets are open there.
    """
    text = '"' + value if inside else value
    start, opened, last, after = None, [], None, 0
    for m in _TOKEN.finditer(text):
        c = m.group()[0]
        if c == '"':
            last, after = m.group()[1:-1], m.end()
        elif c == "]":
            depth -= 1
        else:
            if depth == 1:
                named = last is not None and _NAME.match(text[after: m.start()])
                opened.append(last if named and c == "[" else None)
            if depth == 2 and c == "{" and start is None:
                start = m.start() - inside
            depth += 1
    return start, opened


def _located(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [landmarks(*row) for row in zip(*(batch.column(k).to_pylist() for k in (-1, -2, -3)))]
        kinds = (pa.int64(), pa.list_(pa.string()))
        yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, k) for c, k in zip(zip(*found) if found else [[]] * 2, kinds))],
                                         names=[*batch.schema.names, "_start", "_opened"])


def document_records(spark: SparkSession, path: str, sections: list[str]) -> DataFrame:
    """``file, section, position, record``: the objects of the top-level arrays ``sections`` of JSON documents, as text.

    ``position`` counts from 0 within the array. A document that ends inside a string or at
    another depth than it began, or that lacks one of the sections, stops the job. Records are
    held whole, one at a time; a document is not. Files must be in UTF-8.
    """
    raw = spark.read.option("lineSep", "}").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_at"), F.monotonically_increasing_id().alias("_n"),
        F.col("_metadata.file_size").alias("_size"), "value")
    order = [F.col("_at"), F.col("_n")]
    blocked = with_blocks(raw, [F.col("file"), *order])
    quotes = F.length(F.regexp_replace(F.regexp_replace("value", r"(?s)\\.", ""), '[^"]', "")).cast("bigint")
    first = prefix_scan(blocked.withColumn("_q", quotes), ["file"], order, sums={"_quotes": F.col("_q")})
    inside = (F.col("_quotes") - F.col("_q")) % 2 == 1
    closes = F.col("_quotes") % 2 == 0  # the brace after the piece is not part of a string
    bare = F.regexp_replace(F.concat(F.when(F.col("_inside"), '"').otherwise(""), "value"), r'(?s)"(?:\\.|[^"\\])*+(?:"|$)', "")
    opens = F.length(F.regexp_replace(bare, r"[^\[{]", "")) - F.length(F.regexp_replace(bare, r"[^\]]", ""))
    stepped = first.withColumns({"_inside": inside, "_closes": closes}).withColumn("_opens", opens.cast("bigint")).withColumn("_step", F.col("_opens") - F.col("_closes").cast("bigint"))
    deep = prefix_scan(stepped, ["file"], order, sums={"_depth": F.col("_step")})
    deep = deep.select("file", "_at", "_n", "_size", "_block", "_quotes", "_depth", (F.col("_closes") & (F.col("_depth") == 2)).alias("_ends"),
                       (F.col("_depth") - F.col("_step")).cast("int").alias("_level"), "_inside", "value")
    shape = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in deep.schema.fields)
    marked = deep.mapInArrow(_located, f"{shape}, _start bigint, _opened array<string>")
    place = F.struct("_at", "_n")
    marked = prefix_scan(marked, ["file"], order, sums={"_ended": F.col("_ends").cast("bigint")},
                         maxes={"_within": F.when(F.size("_opened") > 0, F.struct(place.alias("at"), F.get("_opened", F.size("_opened") - 1).alias("name")))})
    # Checks, first records and every section read this; the tokens are looked for once.
    marked = durable(marked.select("file", "_at", "_n", "_size", "_quotes", "_depth", "_level", "_ends", "_start", "_opened", "value", F.col("_within.name").alias("section"),
                                   (F.col("_ended") - F.col("_ends").cast("bigint")).alias("_record")))
    # A file that ends with a brace has as many braces as pieces; else its last piece is followed by none.
    ended = marked.groupBy("file").agg(
        F.max_by(F.struct("_quotes", "_depth"), F.struct("_at", "_n")).alias("last"), F.array_distinct(F.flatten(F.collect_set("_opened"))).alias("found"),
        (F.sum(F.octet_length("value")) + F.count(F.lit(1)) - F.first("_size")).alias("missing"))
    whole = (F.col("last._quotes") % 2 == 0) & (F.col("last._depth") == -F.col("missing")) & F.col("missing").isin(0, 1)
    wanted = F.array(*[F.lit(s) for s in sections])
    checked = ended.select("file", F.when(~whole, F.raise_error(F.concat(F.col("file"), F.lit(" is not one whole JSON document"))).cast("int")).when(
        F.size(F.array_except(wanted, "found")) > 0, F.raise_error(F.concat(F.col("file"), F.lit(" needs "), F.array_join(wanted, ", "))).cast("int")).otherwise(0).alias("_good"))

    text = F.when(F.col("_start").isNotNull(), F.substr("value", F.col("_start") + 1)).otherwise(F.col("value"))
    pieces = marked.where((F.col("_start").isNotNull() | (F.col("_level") >= 3)) & F.col("section").isin(sections))
    records = pieces.groupBy("file", "section", "_record").agg(
        F.array_sort(F.collect_list(F.struct("_at", "_n", text.alias("text")))).alias("parts"), F.bool_or("_ends").alias("_whole")).where("_whole")
    # A record is whole if one of its pieces ends it, so the first one is known before the text is put together.
    firsts = pieces.where("_ends").groupBy("file", "section").agg(F.min("_record").alias("_first"))
    # The check is made here, also where a section holds nothing.
    known = durable(checked.join(firsts, "file", "left")).where("_good = 0")
    return records.join(known, ["file", "section"]).select(
        "file", "section", (F.col("_record") - F.col("_first")).alias("position"), F.concat(F.array_join(F.col("parts.text"), "}"), F.lit("}")).alias("record"))
