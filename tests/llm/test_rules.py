"""Quality rules, licences, decontamination and language identification."""

import collections
import math
import random
import re
import textwrap

import pytest
from pyspark.sql import functions as F

from pixelmill.llm import decontaminate, langid, licenses, quality
from pixelmill.llm.queries import ORACLE_SQL, QUERIES
from tests.conftest import same_rows
from tests.llm.conftest import odd_rows, shingles

WORD = re.compile("[^\x20\x09-\x0d]+")


def measures(text):
    t = text or ""
    w, seen, dup = WORD.findall(t), set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    n = collections.Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
    covered = {k + j for k in range(len(w) - 7) if n[tuple(w[k : k + 8])] > 1 for j in range(8)}
    return len(w), sum(map(len, w)), len(re.findall("[#*$%&|<>]", t)), dup, len(covered)


def test_quality_measures(odd, none):
    found = quality.judged(odd, carry=["doc_id"]).collect()
    want = sorted(((i if i is not None else -99), *measures(t)) for i, t, *_ in odd_rows())
    assert sorted(((r.doc_id if r.doc_id is not None else -99), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in found) == want
    for r in found:
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words) and (not r.base_failed or not r.kept)
    assert quality.judged(none).count() == 0
    assert "text" in quality.judged(odd).columns and quality.judged(odd).columns.count("n_words") == 1


def test_quality_on_random_texts(spark):
    r = random.Random(5)
    rows = [(k, "".join(r.choice(["a ", "b ", "é", "\n", "|", " ", "cc ", "Dd "]) for _ in range(r.randint(0, 120)))) for k in range(400)]
    got = {x.doc_id: (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words) for x in quality.ledger(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[i] == measures(t) for i, t in rows)


def test_ablation_equals_counting(odd):
    book = quality.ledger(odd)
    bits = [r.failed_bits for r in book.collect()]
    names = list(quality.rules())
    for r in quality.ablation(book).collect():
        bit = 1 << names.index(r.rule)
        own = [b & quality.V1.mask for b in bits]
        assert (r.n_failed, r.n_only, r.n_without) == (sum(bool(b & bit) for b in own), sum(b == bit for b in own), sum(bool(b & ~bit) for b in own))


def test_policies_nest(spark):
    assert tuple(quality.rules()) == quality.NAMES
    assert quality.BASE.mask & quality.V1.mask == quality.BASE.mask


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_equals_sql(name, spark, duck, sf):
    got, want = same_rows(QUERIES[name](spark, sf), duck, ORACLE_SQL[name])
    assert got == want


def test_licences(spark, odd, none):
    apache = licenses.SENTENCES
    text = "Foo.\n" + "\n".join(apache[k].replace(" the ", "\nthe ") for k in ("apache2-head", "apache2-use")) + " unknown. " + apache["apache2-copy"] + "\nx.\n" + apache["mit-short"].upper()
    rows = [(1, text), (2, apache["apache2-use"] + " " + apache["apache2-head"]), (3, "\n".join(apache[k] for k in ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse")))]
    got = {r.doc_id: r for r in licenses.recognise(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].sentences == ["apache2-head", "apache2-use", "apache2-copy", "mit-short"] and got[1].licenses == ["Apache-2.0", "MIT"]
    assert got[2].licenses == [] and got[3].licenses == ["BSD-3-Clause"]
    assert licenses.recognise(odd).where("size(sentences) > 0").count() == 0 and licenses.recognise(odd).count() == len(odd_rows())
    assert licenses.recognise(none).count() == 0


def test_every_licence_sentence_is_found(spark):
    rows = list(enumerate(licenses.SENTENCES.items()))
    df = spark.createDataFrame([(k, s) for k, (_, s) in rows], "doc_id long, text string")
    got = {r.doc_id: r.sentences for r in licenses.recognise(df).collect()}
    assert all(got[k] == [name] for k, (name, _) in rows)


def test_rules_consume_what_they_match(spark):
    by = licenses.SENTENCES
    join = lambda *ids: "\n".join(by[k] for k in ids)
    bsd2, bsd3 = ("bsd-grant", "bsd-source", "bsd-binary"), ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse")
    rows = [(1, join(*bsd3), ["BSD-3-Clause"]), (2, join(*bsd2), ["BSD-2-Clause"]), (3, join(*bsd3, *bsd2), ["BSD-2-Clause", "BSD-3-Clause"]), (4, join("mit-grant", "mit-notice", "mit-asis", "mit-short"), ["MIT"]),
            (5, join("bsd-source", "bsd-binary", "bsd-endorse"), []), (6, "// SPDX-License-Identifier: GPL-2.0-only\nint x;", ["GPL-2.0-only"]), (7, join("gpl2-free", "gpl-hope", "gpl2-copy"), ["GPL-2.0-or-later"]),
            (8, join("agpl3-free", "gpl-hope"), ["AGPL-3.0-or-later"]), (9, join("mpl2-head", "mpl2-copy"), ["MPL-2.0"])]
    got = {r.doc_id: r.licenses for r in licenses.recognise(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")).collect()}
    assert got == {i: want for i, _, want in rows}
    with pytest.raises(ValueError, match="same sentences"):
        licenses.recognise(spark.createDataFrame([(1, "x")], "doc_id long, text string"), rules=[("A", ["cc0"]), ("B", ["cc0"])])


def test_licence_sql_at_any_wrap(spark):
    import duckdb

    wrap = lambda s, width: "\n".join("# " + x for x in textwrap.wrap(s, width, break_long_words=False, break_on_hyphens=False))
    rows = [(k * 10 + w, f"Code.\n{wrap(s, (20, 40, 50, 100)[w])}\nmore") for k, s in enumerate(licenses.SENTENCES.values()) for w in range(4)]
    rows += [(-1, "\n".join(wrap(licenses.SENTENCES[x], 25) for x in ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse", "mit-short"))), (-2, None), (-3, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    con = duckdb.connect()
    con.register("documents", df.toPandas())
    got = {r.doc_id: (r.sentences, r.licenses) for r in licenses.recognise(df).collect()}
    want = {i: (a.split(",") if a else [], b.split(",") if b else []) for i, _, a, b in con.execute(licenses.oracle_sql()).fetchall()}
    assert got == want and all(len(got[i][0]) == 1 for i, _ in rows if i >= 0) and got[-1][1] == ["BSD-3-Clause", "MIT"]


@pytest.mark.parametrize("width", [1, 12, 30, 54])
def test_licence_sentences_at_any_wrap(spark, width):
    wrap = lambda s, mark: "\n".join(mark + x for x in textwrap.wrap(s, width, break_long_words=False, break_on_hyphens=False))
    rows = [(f"{k}{mark}", f"{mark}Some code.\n{wrap(s, mark)}\nand more") for k, s in licenses.SENTENCES.items() for mark in ("", " * ")]
    got = {r.doc_id: r.sentences for r in licenses.recognise(spark.createDataFrame(rows, "doc_id string, text string")).collect()}
    assert got == {f"{k}{mark}": [k] for k in licenses.SENTENCES for mark in ("", " * ")}
    mit = "\n".join(wrap(licenses.SENTENCES[k], "# ") for k in ("mit-grant", "mit-notice", "mit-asis"))
    assert licenses.recognise(spark.createDataFrame([(1, mit)], "doc_id long, text string")).first().licenses == ["MIT"]


def test_contained(spark, odd, none):
    r = random.Random(6)
    word = lambda: "".join(r.choice("aeiourst") for _ in range(4))
    items = [(k, " ".join(word() for _ in range(n))) for k, n in enumerate((3, 5, 9, 30, 31, 64, 200))] + [(50, None), (51, ""), (None, "a b c d e"), (3, "again " * 7)]
    docs = []
    for k in range(60):
        own = r.choice(items[:7])[1].split()
        for _ in range(r.randint(0, max(1, len(own) // 12))):
            own[r.randrange(len(own))] = word()
        docs.append((k, " ".join([word() for _ in range(r.randint(0, 300))] + own + [word() for _ in range(r.randint(0, 50))]).upper()))
    docs += [(i, t) for i, t, *_ in odd_rows()][:7]
    half = items[3][1].split()
    docs += [(90, " ".join(half[:17])), (90, " ".join(half[13:])), (91, "x " * 400 + " ".join(half[:17])), (91, " ".join(half[13:]) + " y" * 9)]
    sets, owned = collections.defaultdict(set), collections.defaultdict(set)
    for i, t in items:
        if i is not None:
            n = min(5, len((t or "").split()))
            owned[i] |= {tuple(s) for s in shingles(t, n)} if n else set()
    for i, t in docs:
        if i is not None:
            sets[i] |= {s for n in range(1, 6) for s in shingles(t, n) if len(s) == n}
    want = sorted((d, i, len(own & s), len(own)) for d, s in sets.items() for i, own in owned.items() if own and 100 * len(own & s) >= 75 * len(own))
    df, it = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = sorted(map(tuple, decontaminate.contained(df, it).select("doc_id", "item_id", "n_shared", "n_item").collect()))
    assert got == want and want and {(90, 3), (91, 3)} <= {x[:2] for x in want}
    assert decontaminate.clean(df, it).count() == sum(d is None or d not in {x[0] for x in want} for d, _ in docs)
    assert decontaminate.contained(none, it).count() == 0
    assert decontaminate.contained(odd, spark.createDataFrame([], "item_id long, text string")).count() == 0


def test_language_identification(spark, sf, odd, none):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    fold = langid.remainder(F.col("doc_id"), 5)
    models = langid.fit(docs.where(fold != 0))
    held = langid.identify(docs.where(fold == 0), models, carry=["doc_id", "lang"]).toPandas()
    assert (held.lang == held.lang_pred).mean() > 0.97 and held.score.between(0, 1).all()
    got = {r.doc_id: r for r in langid.identify(odd, models).collect()}
    assert got[0].lang_pred == got[1].lang_pred == got[2].lang_pred == "und" and got[0].score == 0
    assert all(r.lang_pred in ("und", *models.languages) for r in got.values())
    assert langid.identify(none, models).count() == 0
    nothing = langid.fit(none)
    assert {r.lang_pred for r in langid.identify(odd, nothing).collect()} == {"und"}


def test_sample_share():
    assert [langid.share_limit(300, n) for n in (0, 1, 300)] == [1 << 53] * 3
    assert langid.share_limit(300, 10**10) / 2**53 == pytest.approx(3e-8, rel=1e-6) and langid.share_limit(300, 1 << 62) == 1


def test_sample_is_bounded_in_bytes(spark, monkeypatch):
    monkeypatch.setattr(langid, "BYTES", 1000)
    monkeypatch.setattr(langid, "LONGEST", 200)
    rows = [(k, "abc def " * 20, "aa") for k in range(100)] + [(1000 + k, "xyz " * 5000, "bb") for k in range(5)] + [(5, "again", "aa")] * 50
    models = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert models.languages == ["aa", "bb"]


def test_und_is_a_text_without_a_letter(spark):
    letters = sorted({0xFEFF, 0x660, 0x3007, 0x2160, 0xAA, 0x16F4, 0x10FFFF, 0x20000, 0x4DC0, 0xA4D0, *range(0x2F0, 0x300)})
    rows = [(k, chr(k)) for k in letters] + [(1, "abc"), (2, "12 !\ufeff")]
    models = langid.fit(spark.createDataFrame([(k, "abc abd " * 9, "xx") for k in range(20)], "doc_id long, text string, lang string"))
    got = {r.doc_id: r.lang_pred for r in langid.identify(spark.createDataFrame(rows, "doc_id long, text string"), models).collect()}
    assert got == {k: "xx" if any(c.isalpha() for c in t) else "und" for k, t in rows}


def brute_entropy(learn, alphabet, text, order=4):
    """Interpolated Kneser-Ney from counters of tuples: cross-entropy per symbol of a text."""
    def symbols(t):
        out = []
        for c in t.lower() + "\0":
            s = (c if c in alphabet else "?") if c.isalpha() else 0
            if s or (out and out[-1]):
                out.append(s)
        return out

    def grams(s, n):
        return [tuple([0] * (n - 1 - k) + s[max(0, k - n + 1) : k + 1]) for k in range(len(s))]

    tables = {order: collections.Counter(g for t in learn for g in grams(symbols(t), order))}
    for n in range(order - 1, 0, -1):
        tables[n] = collections.Counter(g[1:] for g in tables[n + 1])

    def p(gram, n):
        if n == 0:
            return 1 / (len(alphabet) + 1)
        table = tables[n]
        n1, n2 = (sum(c == k for c in table.values()) for k in (1, 2))
        d = min(0.9, n1 / (n1 + 2 * n2)) if n1 and n2 else 0.5
        own = [c for g, c in table.items() if g[:-1] == gram[:-1]]
        lower = p(gram[1:], n - 1)
        return max(table[gram] - d, 0) / sum(own) + d * len(own) / sum(own) * lower if own else lower

    return -sum(math.log10(p(g, order)) for g in grams(symbols(text), order)) / len(symbols(text))


def test_entropies_equal_brute_force(spark):
    r = random.Random(3)
    make = lambda letters, k: " ".join("".join(r.choices(letters, k=r.randint(1, 6))) for _ in range(k))
    rows = [(k, make("aabcd", 12), "aa") for k in range(20)] + [(100 + k, make("abxyyz", 12), "bb") for k in range(20)]
    models = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    alphabet = set(map(chr, models.alphabet))
    texts = ['"ab cd', "xyz", "abxy dc!", "q abc"]
    found, _ = langid._entropies(models, models.numbers(), texts)
    for j, lang in enumerate(models.languages):
        own = sorted((str(i), t) for i, t, x in rows if x == lang)
        learn = [t for k, (_, t) in enumerate(own) if k % 10]
        for k, t in enumerate(texts):
            assert found[k, j] == pytest.approx(brute_entropy(learn, alphabet, t), rel=1e-4)


def test_kneser_ney_sums_to_one():
    import numpy as np

    ids, at = langid._symbols(["abab cab", "bca abc"], np.concatenate((np.zeros(97, int), [1, 2, 3], np.zeros(0x110000 - 100, int))))
    model = langid.KneserNey(*np.unique(langid._grams(ids, at, 4), return_counts=True), 3)
    for context in (0, 1 << 12 | 2, 3 << 24 | 1 << 12 | 2):
        codes = np.array([context << 12 | k for k in range(4)], np.uint64)
        assert (10 ** model.log10(codes)).sum() == pytest.approx(1.0, abs=1e-5)
