"""The binary layouts: round trips, damage, growth."""

import random
import struct

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerframe.errors import BadMagic, DictMismatch, IncompatibleFlags, InvalidPageMagic, OutOfBounds, RecordError
from ledgerframe.sources import codec as C

FIELDS = [C.Field("id", "="), C.Field("score", "~"), C.Field("ok", "?"), C.Field("name", '"'), C.Field("at_ns", "@"), C.Field("raw", "<"), C.Field("late", "?"), C.Field("level", '"')]
VALUES = {"=": st.integers(-(2**63), 2**63 - 1), "~": st.floats(allow_nan=False), "?": st.booleans(), '"': st.text(max_size=9).filter(lambda s: "\0" not in s), "@": st.integers(0, 2**62), "<": st.binary(max_size=9)}
FULL = st.fixed_dictionaries({f.name: VALUES[f.sigil] for f in FIELDS})
PARTIAL = st.fixed_dictionaries({}, optional={f.name: VALUES[f.sigil] for f in FIELDS})


@pytest.mark.parametrize("layout", ["row", "compact", "columnar", "paged"])
@settings(max_examples=40, deadline=None)
@given(rows=st.lists(FULL | PARTIAL, max_size=12), data=st.data())
def test_round_trip(layout, rows, data):
    if layout == "compact":  # packed bools share one cell: present together or not at all
        rows = [r if ("ok" in r) == ("late" in r) else {k: v for k, v in r.items() if k not in ("ok", "late")} for r in rows]
    file = C.RecordFile(C.write_file(FIELDS, rows, layout, 5))
    assert file.count == len(rows) and file.layout == layout
    assert list(file.records()) == rows
    if rows:
        i = data.draw(st.integers(0, len(rows) - 1))
        assert file.record(i) == rows[i]
    with pytest.raises(OutOfBounds):
        file.record(len(rows))


@pytest.mark.parametrize("layout", ["row", "compact", "columnar", "paged"])
def test_damage_raises_only_record_errors(layout):
    rng = random.Random(layout)
    rows = [{"id": i, "score": i / 2, "ok": True, "late": False, "name": f"n{i}", "raw": b"x", "at_ns": i, "level": "INFO"} for i in range(40)]
    good = C.write_file(FIELDS, rows, layout, 16)
    for _ in range(300):
        bad = bytearray(good)
        for _ in range(rng.randrange(1, 4)):
            bad[rng.randrange(len(bad))] = rng.randrange(256)
        bad = bad[: rng.choice([len(bad), len(bad), rng.randrange(len(bad))])]
        try:
            list(C.RecordFile(bytes(bad), verify=False).records())
        except (RecordError, MemoryError):
            pass


def test_null_is_not_absent():
    rows = [{"id": 1, "name": "present"}, {"id": 2, "name": None}, {"id": 3}]
    fields = [C.Field("id", "="), C.Field("name", '"')]
    for layout in ("row", "compact"):
        assert list(C.RecordFile(C.write_file(fields, rows, layout)).records()) == rows


def test_lists_and_long_rows():
    fields = [C.Field("id", "="), C.Field("values", "L")]
    rows = [{"id": 1, "values": [1, -(2**63), 2**63 - 1]}, {"id": 2, "values": [0.5, 1e100]}, {"id": 3, "values": []}]
    assert list(C.RecordFile(C.write_file(fields, rows, "row")).records()) == rows
    wide = [C.Field(f"k{i:03d}", "=") for i in range(255)]
    row = {f.name: i for i, f in enumerate(wide) if i % 3}
    assert C.RecordFile(C.write_file(wide, [row], "row")).record(0) == row


def test_narrow_and_promoted():
    fields = [C.Field("id", "="), C.Field("level", '"')]
    rows = [{"id": i, "level": ("INFO", "WARN")[i % 2]} for i in range(3000)]
    file = C.RecordFile(C.write_file(fields, rows, "compact"))
    assert [f.width for f in file.fields] == [2, 8] and file.header.pool == ["INFO", "WARN"]
    assert file.record(2500) == rows[2500] and len(file.data) < len(C.write_file(fields, rows, "row")) / 2


def test_errors():
    good = C.write_file(FIELDS, [{"id": 1}], "row")
    for bad, error in [(b"XXXX" + good[4:], BadMagic), (good[:8] + bytes(8) + good[16:], DictMismatch), (good[:-1], BadMagic), (good[:20], RecordError), (good[:6] + struct.pack("<H", 7) + good[8:], IncompatibleFlags)]:
        with pytest.raises(error):
            C.RecordFile(bad)
    paged = bytearray(C.write_file(FIELDS, [{"id": 1}], "paged"))
    at = paged.index(C.PAGE)
    paged[at] = 0
    with pytest.raises(InvalidPageMagic):
        list(C.RecordFile(bytes(paged)).records())


def test_growing_files():
    fields = FIELDS[:2]
    rows = [{"id": i, "score": 0.5 * i} for i in range(10)]
    whole = C.write_file(fields, rows, "row")
    offsets = C.RecordFile(whole).offsets
    got, at = C.unsealed_records(whole[: int(offsets[7]) + 5])
    assert got == rows[:7] and at == offsets[7]
    assert C.unsealed_records(whole[: int(offsets[9])], at)[0] == rows[7:9]
    writer = C.PageWriter(fields, 4)
    for row in rows:
        writer.push(row)
    got, at = C.unsealed_pages(bytes(writer.data) + C.encode_page(fields, rows[8:], 2, 8)[:-9])
    assert got == rows[:8]
    with pytest.raises(BadMagic):
        C.RecordFile(bytes(writer.data))
    sealed = writer.seal()
    assert list(C.RecordFile(sealed).records()) == rows and C.unsealed_pages(sealed, at)[0] == rows[8:]


def test_log_recovers_to_the_last_good_record():
    spans = [{"trace_id_hi": 1, "trace_id_lo": i, "span_id": i, "parent_span_id": None, "name": f"op{i}", "service": "s", "start_time_ns": i, "duration_ns": 5, "status_code": 0, "payload": b"{}"} for i in range(5)]
    data = C.log_header() + b"".join(map(C.log_record, spans))
    assert C.recover_log(data) == (spans, len(data))
    got, good = C.recover_log(data[:-3])
    assert got == spans[:4] and C.recover_log(data[:good] + C.log_record(spans[4]))[0] == spans
    assert C.recover_log(data + b"OXYN\xff\xff\xff\xff")[0] == spans
