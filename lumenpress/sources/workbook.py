"""A workbook (.xlsx) as a Spark data source: tasks write fragments of sheets, the commit puts them together.

    workbook.register(spark)
    df.write.format("workbook").option("sheets", "kind").mode("overwrite").save("file:///shared/report.xlsx")
    spark.read.format("workbook").load("file:///shared/report.xlsx")   # sheet, row, cells

Every value of the column named by ``sheets`` has a sheet of its own, headed by the other columns' names; without it there is
one sheet. Rows stand in the order of partitions. A sheet holds SHEET_ROWS rows; more go on in further ones ("name 2").
Fragments have names of their own attempt, so lost and repeated tasks do no harm; an abort removes them, and the workbook
appears whole or not at all. The commit streams fragments through the driver, a piece at a time.

Defined cases: null is an empty cell; a null sheet name is "-"; numbers stay numbers, all else is text; characters that XML
can't hold are left out; an empty table gives one sheet with its head.
"""

from __future__ import annotations

import io
import re
import sys
import uuid
import zipfile
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from xml.etree import ElementTree
from xml.sax.saxutils import escape, quoteattr

from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

SHEET_ROWS = 1_048_575  # of 1,048,576, one is the head
_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PACK = "http://schemas.openxmlformats.org/package/2006"
_BAD = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f￾￿]")


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path else path.replace("file:", "file://", 1) if path.startswith("file:/") else f"file://{path}")


def _cell(v) -> str:
    if v is None:
        return "<c/>"
    if isinstance(v, (int, float)) and not isinstance(v, bool) and v == v and abs(v) != float("inf"):
        return f"<c><v>{v}</v></c>"
    return f'<c t="inlineStr"><is><t xml:space="preserve">{escape(_BAD.sub("", str(v)))}</t></is></c>'


def _row(values) -> bytes:
    return ("<row>" + "".join(map(_cell, values)) + "</row>").encode()


@dataclass
class _Written(WriterCommitMessage):
    partition: int
    files: list[tuple[str, str, int]]  # sheet, fragment, rows


class _Writer(DataSourceWriter):
    def __init__(self, options: dict[str, str], schema: StructType, overwrite: bool):
        self.path, self.by, self.names, self.overwrite = options["path"], options.get("sheets"), schema.names, overwrite
        self.run = uuid.uuid4().hex

    def _folder(self) -> str:
        return f"{_opened(self.path)[1]}.{self.run}"

    def write(self, iterator: Iterator) -> _Written:
        from pyspark import TaskContext

        files, _ = _opened(self.path)
        files.create_dir(self._folder(), recursive=True)
        attempt, out, counts = uuid.uuid4().hex, {}, defaultdict(int)
        for r in iterator:
            values = dict(zip(self.names, r, strict=True))
            sheet = "Sheet"
            if self.by:
                own = values.pop(self.by)
                sheet = "-" if own is None else str(own)
            if sheet not in out:
                name = f"{self._folder()}/{attempt}-{len(out)}"
                out[sheet] = name, files.open_output_stream(name, compression=None)
            out[sheet][1].write(_row(values.values()))
            counts[sheet] += 1
        for _, stream in out.values():
            stream.close()
        return _Written(TaskContext.get().partitionId(), [(s, name, counts[s]) for s, (name, _) in out.items()])

    def commit(self, messages: list[_Written | None]) -> None:
        files, path = _opened(self.path)
        if not self.overwrite and files.get_file_info(path).type != fs.FileType.NotFound:
            raise FileExistsError(self.path)
        parts = defaultdict(list)
        for m in sorted((m for m in messages if m), key=lambda m: m.partition):
            for sheet, name, n in m.files:
                parts[sheet].append((name, n))
        head = _row([n for n in self.names if n != self.by])
        sheets: list[tuple[str, list[str]]] = []
        for sheet in sorted(parts) or ["Sheet"]:
            room, k = 0, 0
            for name, n in parts.get(sheet, []) or [("", 0)]:
                if n > room or not k:  # a fragment is never cut; one of more rows than a sheet has needs more partitions
                    k, room = k + 1, SHEET_ROWS
                    sheets.append((sheet if k == 1 else f"{sheet} {k}", []))
                if n > SHEET_ROWS:
                    raise ValueError(f"a partition has {n} rows for sheet {sheet}: repartition to {SHEET_ROWS} at most")
                sheets[-1][1].extend([name] if name else [])
                room -= n
        temporary = f"{self._folder()}/book"
        files.create_dir(self._folder(), recursive=True)
        with files.open_output_stream(temporary, compression=None) as raw, zipfile.ZipFile(raw, "w", zipfile.ZIP_DEFLATED) as z:
            _parts(z, [s for s, _ in sheets])
            for i, (_, names) in enumerate(sheets, 1):
                with z.open(f"xl/worksheets/sheet{i}.xml", "w", force_zip64=True) as out:
                    out.write(f'<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="{_MAIN}"><sheetData>'.encode() + head)
                    for name in names:
                        with files.open_input_stream(name, compression=None) as part:
                            while piece := part.read(1 << 20):
                                out.write(piece)
                    out.write(b"</sheetData></worksheet>")
        if files.get_file_info(path).type != fs.FileType.NotFound:
            files.delete_file(path)
        files.move(temporary, path)
        files.delete_dir(self._folder())

    def abort(self, messages: list[_Written | None]) -> None:
        files, _ = _opened(self.path)
        if files.get_file_info(self._folder()).type != fs.FileType.NotFound:
            files.delete_dir(self._folder())


def _titles(names: list[str]) -> list[str]:
    """Names that a sheet can have: 31 characters, none of []:*?/\\, each once in any case."""
    out: list[str] = []
    for n in names:
        plain = title = re.sub(r"[\[\]:*?/\\]", "-", _BAD.sub("", n))[:31] or "-"
        k = 1
        while title.lower() in {x.lower() for x in out}:
            k += 1
            title = f"{plain[: 30 - len(str(k))]} {k}"
        out.append(title)
    return out


def _parts(z: zipfile.ZipFile, names: list[str]) -> None:
    kind = "application/vnd.openxmlformats-officedocument.spreadsheetml"
    every = range(1, len(names) + 1)
    z.writestr("[Content_Types].xml", f'<?xml version="1.0" encoding="UTF-8"?><Types xmlns="{_PACK}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/>' + "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="{kind}.worksheet+xml"/>' for i in every) + "</Types>")
    z.writestr("_rels/.rels", f'<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="{_PACK}/relationships"><Relationship Id="rId1" Type="{_REL}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
    z.writestr("xl/workbook.xml", f'<?xml version="1.0" encoding="UTF-8"?><workbook xmlns="{_MAIN}" xmlns:r="{_REL}"><sheets>' + "".join(f'<sheet name={quoteattr(n)} sheetId="{i}" r:id="rId{i}"/>' for i, n in zip(every, _titles(names), strict=True)) + "</sheets></workbook>")
    z.writestr("xl/_rels/workbook.xml.rels", f'<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="{_PACK}/relationships">' + "".join(f'<Relationship Id="rId{i}" Type="{_REL}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in every) + "</Relationships>")


@dataclass
class _Sheet(InputPartition):
    name: str
    part: str


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]

    def _book(self) -> zipfile.ZipFile:
        files, path = _opened(self.path)
        return zipfile.ZipFile(files.open_input_file(path))

    def partitions(self) -> list[_Sheet]:
        z = self._book()
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        sheets = ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{{{_MAIN}}}sheet")
        return [_Sheet(s.get("name"), f"xl/{targets[s.get(f'{{{_REL}}}id')]}") for s in sheets]

    def read(self, partition: _Sheet):
        row = 0
        with self._book().open(partition.part) as part:
            for _, e in ElementTree.iterparse(io.BufferedReader(part)):
                if e.tag == f"{{{_MAIN}}}row":
                    cells = ["".join(c.itertext()) if len(c) else None for c in e.iter(f"{{{_MAIN}}}c")]
                    yield partition.name, row, cells
                    row += 1
                    e.clear()


class Workbook(DataSource):
    """Format "workbook"; see the module."""

    @classmethod
    def name(cls) -> str:
        return "workbook"

    def schema(self) -> str:
        return "sheet string, row bigint, cells array<string>"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options, schema, overwrite)


def register(spark: SparkSession) -> None:
    """Make the format known to a session; its code goes with the plans, as planning workers don't see files shipped to tasks."""
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    spark.dataSource.register(Workbook)
