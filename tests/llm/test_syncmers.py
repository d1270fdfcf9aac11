import hashlib
import random

import pytest

from gable.llm import syncmers


def features(fingerprint):
    return {fingerprint[i : i + 16] for i in range(0, len(fingerprint), 16)}


def likeness(one, other):
    share = len(one & other) / len(one | other) if one | other else 1.0
    return 2 * share / (1 + share)


@pytest.mark.parametrize("block_bytes", [200, 8 << 20])
def test_edited_and_next_by_brute_force(docs_of, block_bytes):
    """Nulls, repeated ids and equal texts, also with a few documents a block; texts have fewer features than a sketch."""
    rng = random.Random(5)
    text = lambda n: " ".join(f"é{rng.randrange(40)}" for _ in range(n))
    pairs = [(i, text(rng.randint(1, 60))) for i in range(40)]
    pairs += [(None, "of no id"), (None, None), (3, "again three"), (3, None), (50, pairs[9][1]), (51, pairs[9][1]), (52, "")]
    ordered = sorted(((-(1 << 63) if d is None else d, (t or "").encode(), d) for d, t in pairs), key=lambda x: x[:2])
    wanted = {}
    for (_, own, d), (_, after, _) in zip(ordered, ordered[1:] + ordered[:1]):
        own, after = own.decode(), after.decode()
        half = len(own) // 2
        edited = (own[: len(own) - half] + after[:half]).encode()
        wanted[d, len(own), hashlib.sha256(edited).hexdigest()] = own, after
    rows = syncmers.edited_likeness(docs_of(pairs).select("doc_id", "text"), block_bytes=block_bytes).collect()
    found = {(r["doc_id"], r["n_chars"], r["edited_sha256"]): r for r in rows}
    assert len(rows) == len(pairs) and set(found) == set(wanted)
    sketch = {wanted[k][0]: features(r["fingerprint"]) for k, r in found.items()}
    for k, r in found.items():
        own, after = wanted[k]
        assert r["near_edited"] == pytest.approx(likeness(sketch[own], features(r["edited_fingerprint"])))
        assert r["near_next"] == pytest.approx(likeness(sketch[own], sketch[after]))
