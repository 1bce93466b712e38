import hashlib
import random
import re

import numpy as np

from tagweave.llm import private_data as P
from tests.llm.conftest import ODD

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
NONE = P.Potentials({}, np.zeros((5, 5)))


def plain(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            good = {
                "email": True,
                "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")),
                "card": 13 <= len(digits) <= 19 and P.luhn(digits),
                "phone": 9 <= len(digits) <= 15,
            }[kind]
            if good:
                out.append((kind, *m.span()))
    return out


def test_base_is_what_the_patterns_find():
    random.seed(5)
    for alphabet in ("a1@.+-( )924 \n", "0123456789 -", "1.2", "@a.b-@"):
        for _ in range(4000):
            text = "".join(random.choice(alphabet) for _ in range(random.randint(0, 40)))
            assert P.base_spans(text) == plain(text), text
    assert P.luhn("4111111111111111") and not P.luhn("4111111111111112")


def test_long_runs_take_linear_time():
    for text in ("1" * 200_000, "a" * 200_000, "1." * 100_000, "+1" + "(" * 200_000, "a@" * 100_000):
        P.base_spans(text)


def test_similar_mentions_are_added_and_others_left():
    text = "Call +1 (724) 555-7058 or 724-555-7058. Mail jo.96@mail.example.com, JO.96 there. Order 12345678901, jo 96."
    base, spans = P.all_spans(text, NONE)
    assert set(base) <= set(spans)
    assert {text[s:e] for _, s, e in set(spans) - set(base)} == {"724-555-7058", "JO.96"}
    alone = "Order 12345678901 of 724-555-7058 and jo.96"
    assert P.all_spans(alone, NONE) == ([], [])
    assert P.redacted_text(text, NONE).startswith("Call <PHONE> or <PHONE>. Mail <EMAIL>, <EMAIL> there.")


def test_long_words_and_numbers_are_whole():
    name = "jo.96" + "a" * 70
    suspects = [f"{name}@localhost", "al.77@" + "h" * 90]
    text = f"Mail {name}@mail.example.com or {suspects[0]} and al.77@mail.example.com or {suspects[1]} please."
    base, spans = P.all_spans(text, NONE)
    assert len(base) == 2 and [text[s:e] for _, s, e in spans if (_, s, e) not in base] == suspects
    assert P.base_spans("0" * 5000 + ".0.0.1") == [("ip", 0, 5006)]
    P.tokens(text := "a" * 200_000 + "@" + "b" * 200_000 + "@", P.base_spans(text))


def test_messages_agree_with_enumeration():
    text = "a +1 724 555 7058 b 724 555 7058 c 111 222 3333"
    found = P.tokens(text, P.base_spans(text))
    chain = np.log(np.random.default_rng(1).uniform(0.8, 1.2, (5, 5)))
    got = P.posterior(found, P.Potentials({}, chain))
    assert len(found) == 3 and np.allclose(got.sum(axis=1), 1)
    assert got[1].argmax() == P.LABELS.index("phone") and got[2].argmax() == 0


def test_find(spark, documents):
    rows = [*ODD, (9, "x@y.org 1.2.3.4 +1 234 567 890 " * 2000), (10, "4111 1111 1111 1111")]
    got = {(r["doc_id"], r["spans"]): r for r in P.find(documents(rows)).collect()}
    for doc_id, text in rows:
        want = P.base_spans(text or "")
        r = next(v for k, v in got.items() if k[0] == doc_id)
        joined = ",".join(f"{k}:{s}:{e}" for k, s, e in want)
        assert r["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        assert [r[f"n_{k}"] for k in P.KINDS] == [sum(w[0] == k for w in want) for k in P.KINDS]
        assert set(joined.split(",")) <= set(r["spans"].split(","))
    assert P.find(documents([])).collect() == []
