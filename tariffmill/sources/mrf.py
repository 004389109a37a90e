"""Python data source "mrf": price files of any supported shape -> one table of parts.

    spark.dataSource.register(MrfSource)
    spark.read.format("mrf").load("/landing/*")

One row per part of a file, in the file's order:

    kind       cells                    raw
    file       format, packing          error text, if the file could not be read
    meta       key, value               -
    header     the header's fields      -
    row        the fields of a row      -
    root       -                        metadata and short values of the JSON root
    long_root  key                      - (another value of the root that is too long for it)
    bad_row, bad_item                   the entry that could not be read
    item, modifier, provider_reference, in_network, structure   -   the JSON text of one array entry

A file that cannot be read gives its 'file' row with the error and does not stop the others. A file is one partition, as
compressed files cannot be split; downstream steps repartition by (file, ord). JSON is read in one pass.
"""

from __future__ import annotations

import csv
import glob
import json
import os
from collections.abc import Callable, Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from . import decode
from ..functions.headers import SYNONYMS

SCHEMA = "path string, kind string, ord long, cells array<string>, raw string"
KNOWN = {w: field for field, words in SYNONYMS.items() for w in words}
#: Values of the root that are kept at any length; of other keys only short ones are, and longer ones are reported by name.
ROOT_KEYS = set(
    "hospital_name last_updated_on version hospital_location location_name hospital_address type_2_npi license_information attestation attester_name "
    "confirm_attestation ein cms_certification_number reporting_entity_name reporting_entity_type".split()
)
SHORT = 100_000
ARRAYS = {"provider_references": "provider_reference", "in_network": "in_network", "reporting_structure": "structure", "modifier_information": "modifier"}


def plain(header: str) -> str:
    """normalize_header for the few lines that a reader has to judge."""
    import re

    h = re.sub(r"[\s\-]+", "_", header.strip().lower().strip("\"'“”‘’"))
    return re.sub(r"_+", "_", re.sub(r"[^\w]", "", h)).strip("_")


def field_of(header: str) -> str | None:
    parts = [p.strip().lower() for p in header.strip().strip("\"'“”‘’").split("|")]
    if plain(header) in KNOWN:
        return KNOWN[plain(header)]
    if parts[0] == "code" and len(parts) > 1:
        return "code_type" if len(parts) > 2 and "type" in parts[-1] else "code"
    return KNOWN.get(plain(parts[-1])) if len(parts) == 2 and parts[0] == "standard_charge" else None


class MrfSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "mrf"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> MrfReader:
        return MrfReader(self.options.get("path", ""))


class MrfReader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path = path

    def partitions(self) -> list[InputPartition]:
        found = [p for p in sorted(glob.glob(self.path)) for p in ([p] if os.path.isfile(p) else sorted(glob.glob(f"{p}/*"))) if os.path.isfile(p)]
        return [InputPartition(p) for p in found]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        yield from parts(partition.value)


def parts(path: str) -> Iterator[tuple]:
    try:
        kind, packed = decode.detect(path)
    except Exception as e:  # noqa: BLE001  a broken file must not stop the others
        yield (path, "file", 0, None, f"{type(e).__name__}: {e}")
        return
    try:
        text = lambda: decode.decoded(decode.chunks(path, packed))
        for n, (part, cells, raw) in enumerate(csv_parts(text()) if kind == "csv" else json_parts(text), 1):
            yield (path, part, n, cells, raw)
    except Exception as e:  # noqa: BLE001
        yield (path, "file", 0, [kind, packed], f"{type(e).__name__}: {e}")
        return
    yield (path, "file", 0, [kind, packed], None)


def csv_parts(text: Iterator[str]) -> Iterator[tuple]:
    lines = decode.lines(text)
    head = [x for _, x in zip(range(decode.PREAMBLE), lines)]
    if not head:
        raise decode.BadFile("the CSV file is empty")
    at = decode.header_at(head, lambda fields: sum(1 for f in fields if f.strip() and field_of(f)))
    delimiter = decode.delimiter_of(head[at])
    for key, value in decode.preamble_of(head, at, delimiter):
        yield "meta", [key, value], None
    sample = [x for _, x in zip(range(decode.SAMPLE), lines)]
    fields = decode.fields_of(head[at], delimiter)
    kind_column = next((i for i, f in enumerate(fields) if field_of(f) == "code_type"), None)
    quoting = decode.quoting_of(head[at:], sample, delimiter, kind_column)

    def rest() -> Iterator[str]:
        yield from head[at:]
        yield from sample
        yield from lines

    reader = csv.reader(rest(), delimiter=delimiter, quoting=quoting)
    first = True
    while True:
        try:
            row = next(reader)
        except StopIteration:
            return
        except csv.Error as e:
            yield "bad_row", None, str(e)
            continue
        if row:
            yield ("header" if first else "row"), row, None
            first = False


def json_parts(text: Callable[[], Iterator[str]]) -> Iterator[tuple]:
    """Parts of a JSON document; text() opens it, again where the data array can only be told after a look at all keys."""
    pull = decode.Pull(text())
    if pull.peek() == "[":
        for raw in pull.items():
            fixed = decode.clean(raw)
            value = json.loads(fixed) if fixed else None
            if isinstance(value, dict) and any(k in value for k in ("in_network", "provider_references", "reporting_structure")):
                yield from json_parts(lambda: iter([fixed]))  # noqa: B023  a document wrapped in a list
            else:
                yield ("item", None, fixed) if fixed else ("bad_item", None, raw)
        return
    root: dict[str, object] = {}
    data = None
    for key in pull.members():
        if pull.peek() == "[" and key not in decode.NOT_DATA and (key in ARRAYS or not _scalars(pull)):
            if key not in ARRAYS:
                if data is None:
                    data = key if key == decode.DATA_ARRAYS[0] else data_array(text) or key
                if key != data:
                    pull.value(keep=False)
                    continue
                yield "root", None, json.dumps(root)  # what stands before the data array
            for raw in pull.items():
                fixed = decode.clean(raw)
                yield (ARRAYS.get(key, "item"), None, fixed) if fixed else ("bad_item", None, raw)
        elif key in ARRAYS:
            for raw in pull.items():
                fixed = decode.clean(raw)
                yield (ARRAYS[key], None, fixed) if fixed else ("bad_item", None, raw)
        else:
            raw = pull.value()
            fixed = decode.clean(raw) if key in ROOT_KEYS or len(raw) < SHORT else None
            if fixed:
                root[key] = json.loads(fixed)
            elif len(raw) >= SHORT:
                yield "long_root", [key], None
    if data is None:
        yield "root", None, json.dumps(root)


def data_array(text: Callable[[], Iterator[str]]) -> str | None:
    """The best name of a data array among all keys of the root, wherever it stands; null without one of those names."""
    pull = decode.Pull(text())
    found = set()
    for key in pull.members():
        if pull.peek() == "[":
            found.add(key)
        pull.value(keep=False)
    return next((k for k in decode.DATA_ARRAYS if k in found), None)


def _scalars(pull: decode.Pull) -> bool:
    """The array that starts here holds plain values."""
    while len(pull.buf) - pull.at < 2 and pull.more():
        pass
    i = pull.at + 1
    while True:
        while i < len(pull.buf) and pull.buf[i].isspace():
            i += 1
        if i < len(pull.buf):
            return pull.buf[i] not in "{["
        i -= pull.at
        if not pull.more():
            return True
