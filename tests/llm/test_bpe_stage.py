"""The pipeline's BPE stage decodes what it encodes."""

import numpy as np
import pyarrow as pa
import pytest

from lattica.llm import bpe
from lattica.llm.kernels import column_bytes


def test_ids_must_decode_to_their_text():
    public_tokenizers = pytest.importorskip("public_tokenizers")
    model, encoder = bpe._worker(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    data, offsets = column_bytes(pa.array(["Some words, é 中文", None, "", "more words"]))
    ids, size = bpe.encode_texts(encoder, data, offsets)
    bpe.must_decode(model, ids, size, data, offsets)
    wrong = np.array(ids)
    wrong[0] = wrong[-1]
    moved = np.array(size)
    moved[0], moved[1] = moved[0] - 1, moved[1] + 1
    for i, n in ((wrong, size), (ids, moved)):
        with pytest.raises(ValueError):
            bpe.must_decode(model, i, n, data, offsets)
