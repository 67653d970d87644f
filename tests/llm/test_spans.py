import hashlib
import random
import re

import numpy as np
import pytest

from pixelmill.llm import pii, secrets, spans
from pixelmill.llm.crf import Crf
from tests.llm.conftest import odd_rows

PII = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
SECRET = {"assign": r"(?ai)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", "access": "AKIA[A-Z0-9]+", "hex": "[0-9a-f]+"}


def brute_pii(text):
    out = []
    for kind, p in PII.items():
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")) or kind == "card" and not (14 <= len(d) <= 19 and pii.luhn(d)) or kind == "phone" and not 10 <= len(d) <= 15:
                continue
            out.append((kind, m.start(), m.end(), True))
    return sorted(out)


def brute_secrets(text):
    least = {"assign": lambda m: len(m[2]) >= 8, "access": lambda m: len(m[0]) >= 16, "hex": lambda m: len(m[0]) >= 32}
    return sorted((k, m.start(), m.end(), True) for k, p in SECRET.items() for m in re.finditer(p, text) if least[k](m))


def test_pii_patterns_equal_plain_ones():
    r = random.Random(1)
    for _ in range(6000):
        t = "".join(r.choice("a.@+-1234567890 ()%b\n") for _ in range(r.randint(1, 80)))
        assert sorted(pii.patterns(t)) == brute_pii(t)


def test_secret_patterns_equal_plain_ones():
    r = random.Random(2)
    parts = ["token", "PassWord", "api_key", "apikey", "secret", "AKIA", "=", ":", " ", '"', "'", "deadbeef" * 3, "deadbeef" * 5, "A1B2C3D4E5F6", "x", "\n", "é", "K", "ſecret"]
    for _ in range(6000):
        t = "".join(r.choice(parts) for _ in range(r.randint(1, 14)))
        assert sorted(secrets.patterns(t)) == brute_secrets(t)


def test_rows_alone_and_together():
    """What a row gives doesn't depend on its neighbours in a block."""
    import pyarrow as pa

    r = random.Random(12)
    strings = ["".join(r.choice("abcdefghijkmnpqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ") for _ in range(23)).lower() + r.choice("0123456789Q") for _ in range(60)]
    texts = [f"see {s}" for s in strings] + ["", "call (184) 555-7766", "x " * 50 + strings[0]]
    for find, in ((secrets.finder(secrets.default_ratio()),), (pii.finder(pii.default_field()),)):
        whole = find(pa.record_batch({"spans": texts}), "spans")
        assert whole == [find(pa.record_batch({"spans": [t]}), "spans")[0] for t in texts]
        assert whole == find(pa.record_batch({"spans": texts[::-1]}), "spans")[::-1]


def test_personal_data_in_unspaced_text():
    find = pii.finder(pii.default_field())
    import pyarrow as pa

    pad = "".join(f'"key{k}":"value",' for k in "abcdefgh")
    texts = ["{" + pad + '"phone":"(184)555-7766","next":"x"}', "電話番号は" * 10 + "(184)555-7766" + "です" * 20]
    for t, row in zip(texts, find(pa.record_batch({"spans": texts}), "spans"), strict=True):
        assert "(184)555-7766" in [t[a:b] for k, a, b, _ in row if k == "phone"]
    assert find(pa.record_batch({"spans": ["a1" * 60, "x9/" * 40, pad]}), "spans") == [[], [], []]


@pytest.mark.parametrize(("module", "brute", "kinds"), [(pii, brute_pii, pii.KINDS), (secrets, brute_secrets, secrets.BASE_KINDS)])
def test_odd_rows(odd, none, module, brute, kinds):
    extra = [(90, "call +1 (184) 555-7766 or mail ab.c@mail.example.com é token = '24be64439e3e49cf46b2d7c90f3602a3d0b907ff'")]
    docs = odd.unionByName(odd.sparkSession.createDataFrame(extra, "doc_id long, text string"), allowMissingColumns=True)
    got = {r.doc_id: r for r in module.digest(module.detect(docs, carry=["doc_id"])).collect()}
    for i, t, *_ in [*odd_rows(), *extra]:
        own = sorted(brute(t or ""), key=lambda s: (s[1], kinds.index(s[0])))
        text = ",".join(f"{k}:{a}:{b}" for k, a, b, _ in own)
        assert got[i].base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert all(got[i][f"n_{k}"] == sum(s[0] == k for s in own) for k in kinds)
        assert {x for x in text.split(",") if x} <= set(got[i].spans.split(","))
    assert module.detect(none).count() == 0
    assert module.detect(odd).columns == [*[c for c in odd.columns if c != "spans"], "spans"]


def test_field_finds_what_patterns_miss():
    field = pii.default_field()
    text = "phone (184) 555-7766 then card 1234 5678 9012 3456 and version 2.0 in 1999"
    found = {(k, text[a:b]) for k, a, b in pii.modelled(field, np.frombuffer(text.encode(), np.uint8), np.array([0, len(text)]))[0]}
    assert ("phone", "(184) 555-7766") in found or ("phone", "184) 555-7766") in found
    assert ("card", "1234 5678 9012 3456") in found and not any("1999" in s or "2.0" in s for _, s in found)


def test_field_on_held_out_sentences():
    field, right, total = pii.default_field(), 0, 0
    for line in pii.labelled(200, 99):
        words = [w for w, _ in line]
        names = [pii.features(words[k - 1] if k else None, w, words[k + 1] if k + 1 < len(words) else None) for k, w in enumerate(words)]
        free = np.array([pii.is_free(w) for w in words])
        got = field.viterbi(field.emissions(names, free), np.array([len(words)]))
        right += sum(field.labels[g] == tag for g, (_, tag) in zip(got, line, strict=True))
        total += len(line)
    assert right / total > 0.95


def test_viterbi_equals_brute_force():
    import itertools

    r = np.random.default_rng(5)
    moves = r.normal(size=(3, 3))
    field = Crf(["O", "B-a", "I-a"], {}, np.zeros((1, 3)), moves)
    lengths = np.array([1, 4, 3, 4])
    scores = r.normal(size=(lengths.sum(), 3))
    got, at = field.viterbi(scores, lengths), 0
    for n in lengths:
        best = max(itertools.product(range(3), repeat=int(n)), key=lambda y: moves[0, y[0]] + moves[y[-1], 0] + sum(scores[at + k, v] for k, v in enumerate(y)) + sum(moves[a, b] for a, b in itertools.pairwise(y)))
        assert tuple(got[at : at + n]) == best
        at += n


def test_redaction(spark, odd):
    df = spark.createDataFrame([(1, "é mail ab@c.de now"), (2, None), (3, "none")], "doc_id long, text string")
    assert [r.text for r in pii.redact(df).orderBy("doc_id").collect()] == ["é mail <EMAIL> now", None, "none"]
    assert pii.redact(odd).columns == odd.columns
    assert spans.redacted("abcdefgh", [("x", 1, 4), ("y", 2, 6)]) == "a<X>gh"


def test_random_strings_and_identifiers(spark):
    ratio = secrets.default_ratio()
    samples = secrets.labelled(600, 77)
    score = lambda s: ratio.scores(np.frombuffer(s.encode(), np.uint8), np.array([0]), np.array([len(s)]))[0]
    assert sum((score(s) > ratio.threshold) == yes for s, yes in samples) / len(samples) > 0.95
    text = "key wJalrXUtnFEMIK7MDENGbPxRfiCYEXAMPLEKEY and theQuickBrownFoxJumpsOverLazyDog12"
    row = secrets.digest(secrets.detect(spark.createDataFrame([(1, text)], "doc_id long, text string"))).first()
    assert row.spans == "random:4:42" and row.n_hex == 0


def test_random_strings_joined_to_ordinary_text(spark):
    key = "wJalrXUtnFEMIK7MDENGbPxRfiCYEXAM"
    texts = [f"see {head}{key}{tail} now" for head, tail in (("/home/user/service/config/", ""), ("client.request.header.authorization=", ""), ("", "/home/user/service/config/index"), ("data_file_path_read-", ".html/page/text"))]
    rows = [*enumerate(texts), (9, "see /home/user/service/config/index.html and client.request.header.authorization=none2")]
    got = {r.doc_id: r.spans for r in secrets.digest(secrets.detect(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    assert got == {k: f"random:{t.index(key)}:{t.index(key) + len(key)}" for k, t in enumerate(texts)} | {9: ""}


def test_stretches_equal_brute_force():
    ratio, r = secrets.default_ratio(), random.Random(8)
    pool = [s for s, _ in secrets.labelled(400, 21)]
    score = lambda s: float(ratio.scores(np.frombuffer(s, np.uint8), np.array([0]), np.array([len(s)]))[0])
    some = 0
    for _ in range(150):
        run = "".join(r.choice(("/", "=", "..", "-", "_")) + r.choice(pool)[: r.randint(1, 40)] for _ in range(r.randint(2, 5))).encode()
        cut = [k for k in range(len(run) + 1) if k in (0, len(run)) or run[k - 1] in b"+/_=.-" or run[k] in b"+/_=.-"]
        fit = lambda s: len(s) >= secrets.SHORTEST and s[:1] not in b"+/_=.-" and s[-1:] not in b"+/_=.-" and sum((any(48 <= c < 58 for c in s), any(97 <= c < 123 for c in s), any(65 <= c < 91 for c in s))) > 1

        def best(a, b):
            every = [((score(run[x:y]) - ratio.threshold) * (y - x), x, y) for x in cut for y in cut if a <= x < y <= b and fit(run[x:y])]
            top = max(every, default=(0, 0, 0))
            return [*best(a, top[1]), top[1:], *best(top[2], b)] if top[0] > 0 else []

        want = best(0, len(run))
        some += len(want)
        assert secrets.stretches(ratio, np.frombuffer(run, np.uint8)) == want
    assert some > 50
