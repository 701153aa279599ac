"""What the driver holds while it learns languages."""

import tracemalloc

import numpy as np
import pyarrow as pa

from docloom.llm import language_id


def test_samples_come_to_the_driver_deflated_and_whole():
    rng = np.random.default_rng(6)
    texts = ["", "a", "żółć 1", *("".join(map(chr, rng.integers(97, 123, 9))) + " some words that come again " * 40 for _ in range(50))]
    raw = list(language_id.features(pa.array(texts)))
    sent = [language_id.packed(*x) for x in raw]
    assert [language_id.unpacked(*x) for x in sent] == raw
    assert sum(len(a) + len(b) for a, b in sent) < 0.6 * sum(len(a) + len(b) for a, b in raw)


def test_fitting_holds_no_wider_copy_of_the_sample():
    rng = np.random.default_rng(6)
    rows = []
    for k in range(2000):
        at = np.sort(rng.choice(1 << language_id.BUCKET_BITS, 2500, replace=False)).astype(np.uint16)
        rows.append(("ab"[k % 2], at.tobytes(), np.full(2500, 1 / 2500, np.float32).tobytes()))
    tracemalloc.start()
    model = language_id.fit(rows, epochs=1)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert model.languages == ["a", "b"] and peak < 20e6, peak  # the buckets as 8 bytes each are 40 MB
