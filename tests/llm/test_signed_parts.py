"""Signatures of the near-duplicate stage come out in small parts."""

import pyarrow as pa

from jetforge.llm import simhash


def test_signatures_of_a_batch_in_parts():
    texts = [f"word{i} and some more words of text {i % 7}".encode() for i in range(450)] + [None, b""]
    batch = pa.RecordBatch.from_arrays([pa.array(range(452)), pa.array(texts, pa.binary())], names=["_tx", "_text"])
    parts = list(simhash._signed(iter([batch])))
    assert [p.num_rows for p in parts] == [200, 200, 52]
    whole = pa.Table.from_batches(parts)
    assert whole["_tx"].to_pylist() == list(range(452)) and whole["_n"].to_pylist()[-2:] == [0, 0]
    assert whole["_fp"].to_pylist()[3] == int.from_bytes(simhash.fingerprint(texts[3]).to_bytes(8, "big"), "big", signed=True)
