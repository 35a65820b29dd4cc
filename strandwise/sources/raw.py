"""Raw reads, a file each, as a data source of Spark: `spark.read.format("raw_reads").load(path)`.

Files are listed once, on the driver, and dealt to partitions by size; tasks open them through PyArrow's file systems. Filters on chrom and read_id
are pushed into the reader, which looks at a file's attributes before its signal. A file that can't be read is a row with `reason` and no read.
"""

from __future__ import annotations

import io
import json
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull
from pyspark.sql.types import StructType

from ..schemas import READS

SCHEMA = READS + ", file string, reason string"
PUSHED = ("chrom", "read_id")


@dataclass
class Opened:
    """A file's attributes by the names of READS, and what reads its signal and its events (starts, lengths, bases)."""

    attributes: dict
    load: Callable[[], tuple[np.ndarray, np.ndarray, np.ndarray, Sequence[str]]]


def _text(value) -> str:
    return value.decode() if isinstance(value, bytes) else str(value)


def open_hdf5(data: bytes, group: str, subgroup: str) -> Opened:
    import h5py

    f = h5py.File(io.BytesIO(data), "r")
    read = next(iter(f["Raw/Reads"].values()))
    channel, called = f["UniqueGlobalKey/channel_id"].attrs, f[f"Analyses/{group}/{subgroup}"]
    where = called["Alignment"].attrs if "Alignment" in called else {}

    def load():
        events = called["Events"]
        return read["Signal"][()], events["start"] + int(events.attrs["read_start_rel_to_raw"]), events["length"], [_text(b) for b in events["base"]]

    found = {"read_id": _text(read.attrs["read_id"]), "align_strand": _text(where.get("mapped_strand", "")), "chrom": _text(where.get("mapped_chrom", ""))}
    found |= {"chrom_start": int(where["mapped_start"]) if "mapped_start" in where else None, **{k: float(channel[k]) for k in ("digitisation", "range", "offset")}}
    return Opened(found, load)


def open_npz(data: bytes, group: str, subgroup: str) -> Opened:
    """The same parts in NumPy's archives: `signal`; for each group and subgroup `start`, `length`, `base` under group/subgroup/; and `attributes`, JSON."""
    f = np.load(io.BytesIO(data), allow_pickle=False)
    found = json.loads(str(f["attributes"]))
    shift = found.pop("read_start_rel_to_raw")
    load = lambda: (f["signal"], f[f"{group}/{subgroup}/start"] + int(shift), f[f"{group}/{subgroup}/length"], [_text(b) for b in f[f"{group}/{subgroup}/base"]])
    return Opened({"align_strand": "", "chrom": "", "chrom_start": None} | found, load)


#: What opens a file, by its suffix.
OPENERS: dict[str, Callable[[bytes, str, str], Opened]] = {".fast5": open_hdf5, ".npz": open_npz}


@dataclass
class Files(InputPartition):
    files: list[tuple[str, int]]


class RawReader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        get = lambda name, default: options.get(name, default)
        self.path, self.names = options["path"], schema.names
        self.recursive = str(get("recursive", "true")).lower() == "true"
        self.group, self.subgroup = get("group", "RawGenomeCorrected_000"), get("subgroup", "BaseCalled_template")
        self.bytes = int(get("bytesapartition", 128 << 20))
        self.wanted: dict[str, set] = {}
        self.present: set[str] = set()

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Equalities on chrom and read_id, and that these aren't null, are met here; the others are Spark's."""
        for f in filters:
            name = f.attribute[0] if isinstance(f, EqualTo | In | IsNotNull) and len(f.attribute) == 1 else None
            if name not in PUSHED:
                yield f
            elif isinstance(f, IsNotNull):
                self.present.add(name)
            else:
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.wanted[name] = self.wanted.get(name, values) & values

    def partitions(self) -> Sequence[Files]:
        """Files in the order of their paths, as many in a partition as `bytesapartition` holds."""
        files, root = fs.FileSystem.from_uri(self.path)
        found = [root] if files.get_file_info(root).is_file else fs.FileSelector(root, recursive=self.recursive)
        infos = sorted((i.path, i.size) for i in files.get_file_info(found) if i.is_file and any(i.path.endswith(s) for s in OPENERS))
        out: list[Files] = []
        held = self.bytes
        for path, size in infos:
            if held + size > self.bytes:
                out.append(Files([]))
                held = 0
            out[-1].files.append((path, size))
            held += size
        return out or [Files([])]

    def read(self, partition: Files) -> Iterator[tuple]:
        files, _ = fs.FileSystem.from_uri(self.path)
        for path, _ in partition.files:
            try:
                row = self.row(path, files)
            except ImportError:
                raise
            except Exception as e:  # whatever is wrong with a file, the others are read
                row = {"file": path, "reason": f"{type(e).__name__}: {e}"[:500]}
                row = None if self.wanted or self.present else row
            if row is not None:
                yield tuple(row.get(c) for c in self.names)

    def row(self, path: str, files: fs.FileSystem) -> dict | None:
        with files.open_input_file(path) as f:
            opened = next(o for s, o in OPENERS.items() if path.endswith(s))(f.read(), self.group, self.subgroup)
        if any(opened.attributes[k] not in values for k, values in self.wanted.items()) or any(opened.attributes[k] is None for k in self.present):
            return None
        signal, starts, lengths, bases = opened.load()
        if not len(starts) == len(lengths) == len(bases):
            raise ValueError("starts, lengths and bases of events differ in number")
        events = [(int(s), int(n), b) for s, n, b in zip(starts, lengths, bases)]
        return opened.attributes | {"raw": [float(x) for x in signal], "events": events, "read_strand": "t" if self.subgroup.endswith("template") else "c", "file": path}


class RawReads(DataSource):
    """Options: path (a file or folder), recursive, group and subgroup of the corrected base calls, bytesAPartition."""

    @classmethod
    def name(cls) -> str:
        return "raw_reads"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return RawReader(self.options, schema)


def reads(spark: SparkSession, path: str, recursive: bool = True, group: str = "RawGenomeCorrected_000", subgroup: str = "BaseCalled_template") -> DataFrame:
    """Reads of all raw files in a folder, with `file` and `reason` (why a file couldn't be read, null where it could)."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(RawReads)
    return spark.read.format("raw_reads").option("recursive", recursive).option("group", group).option("subgroup", subgroup).load(path)


def unreadable(rows: DataFrame) -> DataFrame:
    """file and reason of the files that couldn't be read."""
    return rows.filter("reason is not null").select("file", "reason")
