"""The wiki-dump store: the title index, the multistream article source and the site's namespaces.

A task reads a range of stream offsets of the bz2 file and yields their pages as rows; ``register`` adds the
data source ``multistream`` for a few given offsets. The one file of a dump is opened by path, in tasks and, for
its header, on the driver, so dumps belong on storage that is mounted on all machines."""

from __future__ import annotations

import bz2
import os
import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from millrace.scratch import written

INDEX = r"^(\d+):(\d+):(.*)$"
ARTICLE = "id long, title string, model string, body string, redirect string, offset long"
HEADER = 128 << 10


def title_index(spark: SparkSession, path: str) -> DataFrame:
    """(offset, id, title) of an index file; a line that isn't ``offset:id:title`` fails the job, as it must."""
    lines = spark.read.text(path).filter(F.col("value") != "")
    bad = F.raise_error(F.concat(F.lit("bad index line: "), F.col("value")))
    ok = F.col("value").rlike(INDEX)
    part = lambda i: F.regexp_extract("value", INDEX, i)
    return lines.select(F.when(ok, part(1).cast("long")).otherwise(bad.cast("long")).alias("offset"), part(2).cast("long").alias("id"), part(3).alias("encoded")).select("offset", "id", _decoded(F.col("encoded")).alias("title"))


def _decoded(x):
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#039;", "'"), ("&amp;", "&")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def stream(path: str, offset: int, chunk: int = 1 << 16) -> bytes:
    """The bytes of the bz2 stream at an offset."""
    d, out = bz2.BZ2Decompressor(), []
    with open(path, "rb") as f:
        f.seek(offset)
        while not d.eof:
            data = f.read(chunk)
            if not data:
                break
            out.append(d.decompress(data))
    return b"".join(out)


def _strip(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def pages(data: bytes) -> Iterator[tuple]:
    """(id, title, model, body, redirect) of the pages of one stream."""
    text = re.sub(rb"</mediawiki>\s*$", b"", data)
    for page in ET.fromstring(b"<pages>" + text + b"</pages>"):
        if _strip(page.tag) != "page":
            continue
        own: dict[str, str | None] = {}
        redirect = None
        for e in page:
            name = _strip(e.tag)
            if name in ("title", "id"):
                own[name] = e.text
            elif name == "redirect":
                redirect = e.get("title")
            elif name == "revision":
                for r in e:
                    if _strip(r.tag) in ("model", "text"):
                        own[_strip(r.tag)] = r.text
        yield int(own["id"] or 0), own.get("title"), own.get("model") or "wikitext", own.get("text") or "", redirect


def header(path: str) -> dict:
    """site_name, creation_date and namespaces {id: (case, name)} of a dump's first stream."""
    with open(path, "rb") as f:
        magic = f.read(4)
    if magic[:3] != b"BZh":
        raise ValueError("not a bz2 dump")
    data = stream(path, 0)
    if len(data) > HEADER:
        raise ValueError("the first stream is too long to be a header")
    root = ET.fromstring(data + b"</mediawiki>") if b"</mediawiki>" not in data else ET.fromstring(data)
    out: dict = {"site_name": None, "namespaces": {}}
    for e in root.iter():
        if _strip(e.tag) == "sitename":
            out["site_name"] = e.text
        elif _strip(e.tag) == "namespace":
            out["namespaces"][int(e.get("key"))] = (e.get("case", "first-letter"), e.text or "")
    m = re.search(r"(?<!\d)(\d{8})(?!\d)", path.rsplit("/", 1)[-1])
    out["creation_date"] = m[1] if m else None
    return out


def namespaces(spark: SparkSession, path: str) -> DataFrame:
    return spark.createDataFrame([(k, name, case) for k, (case, name) in header(path)["namespaces"].items()], "id int, name string, case string")


class _Range(InputPartition):
    def __init__(self, offsets: list[int]) -> None:
        self.offsets = offsets


class _Reader(DataSourceReader):
    def __init__(self, options) -> None:
        self.path = options["path"]
        self.offsets = sorted({int(x) for x in options["offsets"].split(",")}) if options.get("offsets") else []
        self.per_task = int(options.get("streamspertask", "16"))

    def partitions(self) -> list[InputPartition]:
        return [_Range(self.offsets[i : i + self.per_task]) for i in range(0, len(self.offsets), self.per_task)]

    def read(self, partition: _Range) -> Iterator[tuple]:
        for offset in partition.offsets:
            for page in pages(stream(self.path, offset)):
                yield (*page, offset)


class MultistreamSource(DataSource):
    """The streams at a few offsets. Options: path, offsets (comma-separated), streamsPerTask."""

    @classmethod
    def name(cls) -> str:
        return "multistream"

    def schema(self) -> str:
        with open(self.options["path"], "rb") as f:
            if f.read(3) != b"BZh":
                raise ValueError("not a bz2 dump")
        return ARTICLE

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(MultistreamSource)


def articles(spark: SparkSession, path: str, index: str, offsets: list[int] | None = None, per_task: int = 16) -> DataFrame:
    """The dump's articles; given a few offsets, only these streams are read.

    All offsets come from the index, which Spark reads and deals to tasks in ranges of neighbours, about ``per_task``
    streams each; the driver sees none of them."""
    if offsets is not None:
        register(spark)
        return spark.read.format("multistream").option("path", path).option("offsets", ",".join(map(str, offsets))).option("streamsPerTask", per_task).load()
    header(path)
    found = title_index(spark, index if "://" in index or not os.path.isabs(index) else f"file://{index}").select("offset").distinct()
    found = written(found, "offsets")
    dealt = found.repartitionByRange(max(1, -(-found.count() // per_task)), "offset").sortWithinPartitions("offset")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for offset in b["offset"]:
                rows = [(*page, offset) for page in pages(stream(path, int(offset)))]
                yield pd.DataFrame(rows, columns=["id", "title", "model", "body", "redirect", "offset"])

    return dealt.mapInPandas(read, ARTICLE)


def get_articles(spark: SparkSession, path: str, index: str, titles: list[str]) -> DataFrame:
    """The articles of a few titles: a scan of the index, then only the streams that hold them."""
    found = title_index(spark, index).filter(F.col("title").isin(titles)).collect()
    if not found:
        return spark.createDataFrame([], ARTICLE)
    return articles(spark, path, index, sorted({r.offset for r in found})).filter(F.col("id").isin([r.id for r in found]))
