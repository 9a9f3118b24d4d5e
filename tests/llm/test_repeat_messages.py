"""How many bytes the messages of op7 take; the exchange compresses with lz4, as here."""

import random

import numpy as np
import pyarrow as pa

from tessera.llm import blocks, suffix_repeats


def block():
    r = random.Random(8)
    words = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randrange(2, 9))) for _ in range(1500)]
    texts = [" ".join(r.choice(words) for _ in range(400)) for _ in range(400)]
    return pa.table({"doc_id": pa.array(range(1000, 1400), pa.int64()), "text": texts})


def lz4(column):
    return len(pa.compress(b"".join(column.to_pylist()), codec="lz4", asbytes=True))


def test_bytes_of_keys_and_contexts():
    table, key, length = block(), (pa.scalar(0),), 50
    sent = suffix_repeats._send_keys(4, length)(key, table)
    keys = sum(blocks.joined(sent["b"], np.dtype(np.uint16))[1])
    assert lz4(sent["a"]) < 4 * keys  # 48 bits in eight bytes: 6.8 bytes a key

    answers = pa.concat_tables([blocks.messages(np.array([m["bucket"]]), 0, 0, pa.array([bytes([suffix_repeats.CODE_SHARED]) * (len(m["b"]) // 2)], pa.binary())) for m in sent.to_pylist()])
    contexts = suffix_repeats._send_contexts(4, length)(key, table, answers)
    raw = sum(blocks.joined(contexts["b"], np.dtype(np.uint32))[0])
    assert lz4(contexts["a"]) < 0.42 * raw  # plain: 0.51

    back = [blocks.opened(m["a"], int(np.frombuffer(m["b"], np.uint32).sum())) for m in contexts.to_pylist()]
    windows = {x[i : i + length] for x, m in zip(back, contexts.to_pylist(), strict=True) for x in np.split(np.frombuffer(x, np.uint8), np.cumsum(np.frombuffer(m["b"], np.uint32))[:-1]) for x in [x.tobytes()] for i in range(len(x) - length + 1)}
    assert windows == {t[i : i + length].encode() for t in table["text"].to_pylist() for i in range(len(t) - length + 1)}


def test_squeezed_bytes_come_back():
    for data in (b"", b"a", b"ab" * 500, np.random.RandomState(9).bytes(300)):
        frame = blocks.squeezed(data)
        assert len(frame) <= len(data) and blocks.opened(frame, len(data)) == data
