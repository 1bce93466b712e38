import hashlib

import numpy as np

from tagweave.llm import order_minhash as O
from tests.llm.conftest import ODD

LONG = " ".join(str(i * 7919 % 10007) for i in range(6000))


def selected(text):
    """The signature by sorting every k-mer under every function."""
    plain, numbered = O.kmers(text)
    seen, names = {}, set()
    k = min(O.K, len(text))
    for i in range(len(text) - k + 1):
        g = text[i : i + k]
        names.add((g, seen.setdefault(g, 0)))
        seen[g] += 1
    assert len(names) == len(plain) == len(set(numbered.tolist()))
    values = (numbered >> np.uint64(32)).astype(np.uint32)[None, :] * O._MULTIPLY
    at = np.sort(np.argsort(values, axis=1, kind="stable")[:, : O.L], axis=1)
    return (O.mix((plain[at] * O._ORDER[: at.shape[1]]).sum(axis=1, dtype=np.uint64)) & np.uint64(0xFFFF)).astype(np.uint16)


def test_selection():
    for text in ("a", "short", "exactly8", "nine char", "a" * 500, "abab" * 300, LONG, "wörd 日本 " * 50):
        assert (O.fingerprint(text) == selected(text)).all(), text[:20]
    assert len(O.fingerprint("")) == 0


def test_likeness_follows_edits_and_order():
    words = LONG.split()[:400]
    text = " ".join(words)
    moved = " ".join(words[200:] + words[:200])
    small = text.replace(words[50], "zz", 1)
    f = O.fingerprint
    assert O.likeness(f(text), f(text)) == 1.0
    assert O.likeness(f(text), f(small)) > 0.85 > 0.7 > O.likeness(f(text), f(moved)) > 0.3
    assert O.likeness(f(text), f("")) == 0.0 and O.likeness(f(""), f("")) == 1.0


def test_table(spark, documents):
    rows = [*ODD, *((20 + 3 * i, LONG[i * 40 : i * 40 + 200 + i * 3]) for i in range(60))]
    for parts in (1, 7):
        spark.conf.set("spark.sql.shuffle.partitions", str(parts))
        got = O.fingerprints(documents(rows).repartition(3)).collect()
        got.sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0))
        order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
        assert len(got) == len(rows)
        for i, ((doc_id, text), r) in enumerate(zip(order, got)):
            text, following = text or "", order[(i + 1) % len(order)][1] or ""
            edited = O.edited_text(text, following)
            assert r["doc_id"] == doc_id and r["n_chars"] == len(text)
            assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
            assert r["near_next"] == O.likeness(O.fingerprint(text), O.fingerprint(following))
            assert r["near_edited"] == O.likeness(O.fingerprint(text), O.fingerprint(edited))
            assert bytes.fromhex(r["fingerprint"]) == O.fingerprint(text).astype(">u2").tobytes()
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    one = O.fingerprints(documents([(1, LONG)])).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1.0
    assert O.fingerprints(documents([])).collect() == []
