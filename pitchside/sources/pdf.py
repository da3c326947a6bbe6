"""Page counts of report files (C8: the pages of the shooting maps move with the number of pages).

Nothing is rendered: a report's objects are looked through for the root of its page tree,
also where they are packed in compressed object streams. One pass over the
files in tasks, one row per file; only path and count leave the task.
"""

from __future__ import annotations

import re
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Bytes that a packed object stream may unpack to (a broken or hostile file must not fill a worker).
STREAM_BYTES = 64 << 20


def page_counter():
    """``count(content) -> pages or None`` as a nested function, so that tasks need no package of ours."""
    edges = re.compile(rb"\b(?:end)?obj\b")
    tree, leaf = re.compile(rb"/Type\s*/Pages(?![A-Za-z])"), re.compile(rb"/Type\s*/Page(?![A-Za-z])")
    number, parent = re.compile(rb"/Count\s+(\d+)"), re.compile(rb"/Parent\b")
    packed, first, data = re.compile(rb"/Type\s*/ObjStm"), re.compile(rb"/First\s+(\d+)"), re.compile(rb"\bstream\r?\n(.*)endstream", re.S)
    most = STREAM_BYTES

    def bodies(content):
        begun = None
        for m in edges.finditer(content):
            if m[0] == b"obj":
                begun = m.end() if begun is None else begun
                continue
            body, begun = content[begun:m.start()] if begun is not None else b"", None
            if packed.search(body) and (stream := data.search(body)) and (begin := first.search(body)):
                try:
                    plain = zlib.decompressobj().decompress(stream[1], most) if b"FlateDecode" in body else stream[1]
                    head = [int(x) for x in plain[:int(begin[1])].split()]
                except (zlib.error, ValueError):
                    continue
                starts = [int(begin[1]) + at for at in head[1::2]]
                yield from (plain[s:e] for s, e in zip(starts, [*starts[1:], len(plain)]))
            else:
                yield body.partition(b"stream")[0]

    def count(content):
        root, leaves = None, 0
        if content is None or b"%PDF-" not in content[:1024]:
            return None
        for body in bodies(content):
            if tree.search(body):
                # the root of the tree has no parent; a later version of it replaces an earlier one
                if not parent.search(body) and (n := number.search(body)):
                    root = int(n[1])
            elif leaf.search(body):
                leaves += 1
        return root if root is not None else leaves or None

    return count


def read_page_counts(spark: SparkSession, root: str, glob: str = "*.pdf") -> DataFrame:
    """``path, page_count`` of the report files one folder below ``root``; NULL where a file is no readable report."""
    count = page_counter()

    def run(batches):
        for b in batches:
            pages = [count(x.as_buffer().to_pybytes() if x.is_valid else None) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(pages, pa.int32())], names=["path", "page_count"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(f"{root.rstrip('/')}/*")
    return files.selectExpr("regexp_replace(path, '^file:', '') AS path", "content").mapInArrow(run, "path string, page_count int")
