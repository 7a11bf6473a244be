"""Prompt files that hold one JSON array each, read in byte ranges.

A range starts at the first object that begins in it. Its place is told from the
bytes around it alone, so a range needs nothing from those before it: outside of
strings, ``{`` followed by a quote and the first letter of a key begins an object.
Inside a string a quote without a backslash ends it, and what follows an ended
string is white space, a comma, a colon or a closing bracket, never a key's letter.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from runlens.operators.prompts import require_domains
from runlens.schemas import PROMPT
from runlens.session import ship_package

RANGE_BYTES = 32 << 20
#: bytes read at a time to find where the last object of a range ends
_AHEAD = 1 << 20
_BEGIN = re.compile(rb'\{[\x20\t\r\n]*"[^\x20\t\r\n,:}\]]')
_KEYS = {"prompt_id": str, "domain": str, "raw_text": str, "token_count": int}
_ARROW = pa.schema([(k, pa.string() if t is str else pa.int64()) for k, t in _KEYS.items()])


class ByteRange(InputPartition):
    def __init__(self, path: str, start: int, end: int, size: int):
        self.path, self.start, self.end, self.size = path, start, end, size


def _object(pairs: Sequence[tuple[str, object]]) -> dict:
    """One object, with exactly the four keys, each once and of its type."""
    row = dict(pairs)
    if len(row) != len(pairs) or row.keys() != _KEYS.keys():
        raise ValueError(f"prompt keys must be {', '.join(_KEYS)}; got {', '.join(k for k, _ in pairs)}")
    for key, kind in _KEYS.items():
        if type(row[key]) is not kind:
            raise ValueError(f"{key} must be a {kind.__name__}; got {row[key]!r}")
    return row


def objects_in_range(file, start: int, end: int, size: int) -> list[dict]:
    """The objects that begin at a byte from ``start`` up to, but not at, ``end``."""
    # an object's brace at the end is known by the bytes after it, so these are read, too
    file.seek(start)
    data = file.read(min(end + _AHEAD, size) - start)
    first = _BEGIN.search(data)
    lead = data[:first.start()] if first else data
    if start == 0:
        opening = lead.strip(b"\x20\t\r\n")
        if opening == b"[]" and not first and len(data) == size:
            return []
        if opening != b"[":
            raise ValueError("the file is not one array of objects")
    if not first or start + first.start() >= end:
        return []
    at, seen = first.start(), end - start
    while True:
        after = _BEGIN.search(data, seen)
        if after or start + len(data) >= size:
            break
        # again from a little before, should a begin be cut here
        seen = max(end - start, len(data) - 4096)
        data += file.read(_AHEAD)
    body = data[at:after.start() if after else len(data)].rstrip(b"\x20\t\r\n")
    closing = b"," if after else b"]"
    if not body.endswith(closing):
        raise ValueError("the array is cut off")
    rows = json.loads(b"[" + body[:-1] + b"]", object_pairs_hook=_object)
    if not all(isinstance(r, dict) for r in rows):
        raise ValueError("the file is not one array of objects")
    return rows


class PromptArrayReader(DataSourceReader):
    def __init__(self, path: str, range_bytes: int):
        self.path, self.range_bytes = path, range_bytes

    def partitions(self) -> Sequence[InputPartition]:
        fs, root = pafs.FileSystem.from_uri(self.path)
        info = fs.get_file_info(root)
        if info.type == pafs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        files = [info] if info.type == pafs.FileType.File else [
            f for f in fs.get_file_info(pafs.FileSelector(root))
            if f.type == pafs.FileType.File and f.size and not f.base_name.startswith(("_", "."))]
        return [ByteRange(f.path, at, min(at + self.range_bytes, f.size), f.size)
                for f in files for at in range(0, max(f.size, 1), self.range_bytes)]

    def read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        fs, _ = pafs.FileSystem.from_uri(self.path)
        with fs.open_input_file(partition.path) as file:
            rows = objects_in_range(file, partition.start, partition.end, partition.size)
        yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)


class PromptArraySource(DataSource):
    """``spark.read.format("prompt_array")``: options path and range_bytes."""

    @classmethod
    def name(cls) -> str:
        return "prompt_array"

    def schema(self):
        return PROMPT

    def reader(self, schema) -> DataSourceReader:
        return PromptArrayReader(self.options["path"], int(self.options.get("range_bytes", RANGE_BYTES)))


def load_prompt_arrays(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Prompts from one array file, or a folder of them, each read in many tasks.

    Strict: exactly the four keys with their types, known domains, and nothing else
    in the array; anything other raises. ``path`` is a URI of a file system that
    pyarrow reads, or a local path that all executors share. A range is held in
    memory, and one object if it is longer.
    """
    ship_package(spark)
    spark.dataSource.register(PromptArraySource)
    uri = path if "://" in path or path.startswith("file:") else f"file://{path}"
    rows = spark.read.format("prompt_array").option("range_bytes", range_bytes).load(
        re.sub(r"^file:/(?!/)", "file:///", uri))
    return require_domains(rows)


def save_prompt_arrays(prompts: DataFrame, path: str) -> None:
    """Overwrite ``path`` with files of one array each, one for every partition that has rows.

    One object a line, UTF-8, folders created. Coalesce before for a single file.
    """
    names = PROMPT.fieldNames()
    lines = prompts.select(F.to_json(F.struct(*names), {"ignoreNullFields": "false"}).alias("value"))

    def framed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = "["
        for batch in batches:
            if len(batch):
                rows = [f"{before if i == 0 else ','}{line}" for i, line in enumerate(batch.column(0).to_pylist())]
                before = ","
                yield pa.RecordBatch.from_pydict({"value": rows})
        if before == ",":
            yield pa.RecordBatch.from_pydict({"value": ["]"]})
    lines.mapInArrow(framed, "value string").write.mode("overwrite").text(path)
