"""What a Python worker holds: working memory of a step, and what is left for the next one."""

import tracemalloc
from types import SimpleNamespace

import numpy as np
import pyarrow as pa

from docloom.llm import _text, decontaminate, jaccard_join, lm_scoring, toxicity


def test_working_memory_is_some_pieces_of_a_batch():
    rng = np.random.default_rng(3)
    said = np.array([f"w{i:04d}" for i in range(5000)])
    texts = [" ".join(said[rng.integers(0, len(said), 300)]) for _ in range(4000)]  # 7 MB
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["doc_id", "text"])
    tests = SimpleNamespace(value=decontaminate.build_tests([("a", texts[7])]))
    tracemalloc.start()
    found = decontaminate._matches(10, "found", tests, batch.column(1))
    first = tracemalloc.get_traced_memory()[1]
    tracemalloc.reset_peak()
    sets = list(jaccard_join._describe(5, [batch]))
    second = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [i for i, m in enumerate(found["found"]) if m] == [7] and sets[0].num_rows == len(texts)
    assert max(first, second) < 40e6, (first, second)


def test_a_step_drops_what_other_steps_kept():
    model = toxicity.fit(["you idiot", "an idiot", "good day", "fine day"] * 3, [1, 1, 0, 0] * 3)
    _text.begin("toxicity")
    toxicity.scores(["some idiot"], model)
    _text.begin("toxicity")
    assert toxicity._POOLS
    _text.begin("decontaminate")
    assert not toxicity._POOLS


def test_states_beside_counts_are_what_the_counts_tell():
    said = pa.array([f"the {a} cat saw the {b} dog" for a in ("big", "small", "red") for b in ("old", "young", "tired")] * 20)
    times = np.zeros(257, np.int64)
    for r in lm_scoring._count_bytes([pa.RecordBatch.from_arrays([said], names=["text"])]):
        times += r["n"].to_numpy()
    learner = lm_scoring.Learner(lm_scoring.Code(times[:256]), np.full(256, 1 / 256))
    for at in (0, 90):
        for _, _, data, offsets in _text.chunks(said.slice(at, 90)):
            learner.chunk(data, offsets)
        n0, n1 = learner.table.reshape(-1, 2).T
        assert n0.sum() + n1.sum() and not learner.waiting
        assert (learner.state == lm_scoring.states(n0, n1)).all()


def test_what_is_decided_in_the_same_contexts_is_one_decision():
    said = ["the cat sat", "", "The cap sat on a mat. " * 9, "\u0434\u0443\u0431", "the car"]
    code, cut = lm_scoring.Code(np.arange(256)), np.full(256, 1 / 256)
    _, _, data, offsets = next(_text.chunks(pa.array(said)))
    g, starts = lm_scoring.grams(data, offsets)
    alone = lm_scoring.Grams.join([lm_scoring.grams(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())]))[0] for t in said])
    assert (g.key == alone.key).all() and (g.word == alone.word).all() and starts.tolist() == [0, *np.cumsum([len(t.encode()) + 1 for t in said])]
    first, back = lm_scoring.distinct(g.names())
    assert len(first) == len({*g.names().tolist()}) and (g.names()[first][back] == g.names()).all()
    learner = lm_scoring.Learner(code, cut)
    learner.predict(g[first], np.bincount(back), 0.02)
    want, times = set(), 0
    for key, word, n in zip(g.key[first].tolist(), g.word[first].tolist(), np.bincount(back).tolist(), strict=True):
        want |= {(key >> 8, word, int(node)) for node in code.node[: code.length[key & 255], key & 255]}
        times += n * int(code.length[key & 255])
    assert sum(len(slots[0]) for slots, *_ in learner.waiting) == len(want)
    learner.count()
    assert learner.table.sum() == lm_scoring.ORDERS * times and learner.mixer.met.sum() == lm_scoring.ORDERS * times and learner.mixer.near.sum() == times


def test_names_that_share_a_slot_stand_once():
    name = np.random.default_rng(6).integers(0, 2**63, 300_000, dtype=np.uint64)[np.random.default_rng(7).integers(0, 300_000, 900_000)] << np.uint64(1)
    first, back = lm_scoring.distinct(name)
    assert len(first) == len(np.unique(name)) and (name[first][back] == name).all()
