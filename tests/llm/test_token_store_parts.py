"""Long rows reach the encoder a bounded part of their batch at a time."""

import numpy as np
import pyarrow as pa

from wavekin.llm import common
from wavekin.llm import token_store as T


class Recorder:
    def __init__(self):
        self.sizes = []

    def encode_batch(self, texts, end_id):
        self.sizes.append(sum(len(t or "") for t in texts))
        counts = np.array([len(t or "") // 1000 + 1 for t in texts], dtype=np.int64)
        return np.arange(counts.sum(), dtype=np.uint32), counts


def test_a_batch_of_long_rows_is_encoded_in_parts():
    texts = [None, "", *["x" * 700_000] * 12, "y" * (3 * common.PART_BYTES), "z"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], ["doc_id", "text"])
    encoder = Recorder()
    rows = [r for out in T._encode(iter([batch]), encoder, 2, "<u2") for r in out.to_pylist()]
    assert [r["doc_id"] for r in rows] == list(range(len(texts)))
    assert [r["n_tokens"] for r in rows] == [len(t or "") // 1000 + 1 for t in texts]
    assert sum(encoder.sizes) == sum(len(t or "") for t in texts)
    assert max(encoder.sizes) <= 3 * common.PART_BYTES and sorted(encoder.sizes)[-2] <= common.PART_BYTES + 700_000
