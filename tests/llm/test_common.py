import pyarrow as pa

from kickpool.llm import common


def test_slices_end_by_rows_and_by_bytes(monkeypatch):
    monkeypatch.setattr(common, "SLICE_BYTES", 1_000)
    texts = ["x" * 300] * 10 + ["y" * 5_000] + [None, "", "é" * 600] + ["z"] * 2_000
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["id", "text"])
    made = list(common.slices(iter([batch, batch.slice(0, 0)])))
    assert [v for b in made for v in b.column(1).to_pylist()] == texts
    for one in made:
        sizes = [len((v or "").encode()) for v in one.column(1).to_pylist()]
        assert one.num_rows <= common.SLICE_ROWS and sum(sizes[:-1]) < 1_000
    assert len(made) < 20


def test_rows_without_texts_are_sliced_by_number():
    batch = pa.RecordBatch.from_arrays([pa.array(range(1_200))], names=["id"])
    assert [b.num_rows for b in common.slices(iter([batch]))] == [512, 512, 176]
