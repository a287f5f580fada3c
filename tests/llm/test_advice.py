"""What a review found cut short."""

import random
import string
from difflib import SequenceMatcher
from itertools import combinations

import pytest
from plain_leaks import leaks, search
from pyspark.sql import functions as F

from quillmill import queries as engine
from quillmill.llm import decontaminate, quality_rules, secrets
from quillmill.operators import ensemble
from quillmill.plans import recognise


def test_symbol_heavy_documents_by_risk(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    short = {r.stratum: (r.n_good, set(r.signals)) for r in quality_rules.uncertified(docs, labels, risk=0.0025).collect()}
    every = {s for s, _, _ in quality_rules.SIGNALS}
    assert short == {"en": (2076, every), "de": (507, every), "fr": (505, every), "es": (321, every)}
    assert quality_rules.uncertified(docs, labels).isEmpty()
    judged = quality_rules.judge(docs, labels)
    by = labels.groupBy("doc_id").agg(F.max("quality").alias("high"))
    heavy = judged.join(by.where("high = 0"), "doc_id", "left_semi").where("n_symbols > 0.05 * word_chars")
    assert heavy.count() == 303 and heavy.where("kept").isEmpty()
    good = judged.join(by.where("high = 1"), "doc_id", "left_semi").where("not base_failed")
    assert good.where("not kept").count() <= 0.02 * good.count()


SHOP = "In the shop Tom has 3 apples and Sue has 5 apples and Ann has 2 apples. How many apples do they have together?"
PEARS = "At noon Tom buys 3 red apples and 4 pears, then Sue buys 5 red apples and 6 pears, then Ann buys 2 red apples and 9 pears."


def test_items_with_parallel_clauses():
    items = [(1, SHOP), (2, PEARS)]
    for item, text, n in ((1, SHOP, 17), (2, PEARS, 21)):
        (hit,) = [h for h in search(items, f"Some words before. {text} Some words after.") if h[0] == item]
        assert hit[1:3] == (n, n) and hit[4] == 0 and decontaminate.leaked(hit[1], hit[2], hit[5])
    changed = SHOP.replace("Tom", "Max").replace("3", "30").replace("2", "21")
    (hit,) = search(items, f"{changed} {changed}")
    assert hit[1:3] == (17, 17) and hit[4] == 3 and hit[5]
    longer = PEARS.replace("then Sue", "and a little later that day Sue")
    assert [h[0] for h in leaks(items, longer)] == [2]


def test_names_that_open_sentences():
    item = "Tom has 3 apples. Sue has 5 apples. Ann eats 2 apples. How many apples are left?"
    swap = lambda text, names: " ".join(names.get(w, w) for w in text.split(" "))
    other = {"Tom": "Max", "Sue": "Eva", "Ann": "Kim"}
    (hit,) = search([(1, item)], swap(item, other))
    assert hit == (1, 10, 10, 7, 3, True)
    assert leaks([(1, item)], "Before it. Yesterday " + swap(item, other | {"3": "30", "5": "7"}))
    twice = [(2, "Tom walks to the old red barn. Tom takes some of the eggs to town. Tom sells them all.")]
    text = "Max walks to the old red barn. {} takes some of the eggs to town. {} sells them all."
    found = [max([h[1] for h in search(twice, text.format(a, b)) if h[5]], default=0) for a, b in (("Max", "Max"), ("Eva", "Kim"))]
    assert found[0] == search(twice, twice[0][1])[0][2] and found[1] < found[0]
    assert search([(1, item)], item.lower())[0][1] == 10


def test_names_stand_for_one_name_each():
    """Two names of the item as one of the document is another question; numbers may coincide."""
    item = "In the small shop Tom gives 3 of the apples to Sue and then Sue gives 5 of the pears back to Tom again"
    swap = lambda **to: " ".join(to.get(w, w) for w in item.replace("3", "Three").replace("5", "Five").split(" "))
    assert search([(1, item)], swap(Tom="Max", Sue="Eva"))[0][5]
    assert not leaks([(1, item)], swap(Tom="Max", Sue="Max"))
    assert leaks([(1, item)], swap(Tom="Max", Sue="Eva", Three="4", Five="4"))


ALPHABETS = {
    "base64": string.ascii_letters + string.digits + "+/", "base62": string.ascii_letters + string.digits, "base36": string.ascii_lowercase + string.digits,
    "base32": string.ascii_uppercase + "234567", "hex": "0123456789ABCDEF",
}


@pytest.mark.parametrize("kind", sorted(ALPHABETS))
def test_random_tokens_of_any_length_are_novel(kind):
    g = random.Random(5)
    for n in (16, 32, 64, 100, 200, 400, 1500, 4000):
        for _ in range(10):
            token = "A2" + "".join(g.choices(ALPHABETS[kind], k=n - 2))
            text = f"The service reads this file at start.\nauth header = {token}\nend of it\n"
            assert [text[a:b] for a, _, b in secrets.novel_spans(text, [])] == [token]


def test_tokens_of_letters_or_digits_only():
    """Every candidate is measured; what could be a word must cost more than the letters around it do."""
    g = random.Random(7)
    for letters, n, least in ((string.ascii_lowercase, 28, 90), (string.ascii_uppercase, 28, 95), (string.ascii_letters, 24, 99), (string.digits, 24, 99), (string.ascii_lowercase, 200, 99)):
        found = 0
        for _ in range(100):
            token = "".join(g.choices(letters, k=n))
            text = f"The service reads this file at start.\nauth bearer {token}\nend of it\n"
            found += [text[a:b] for a, _, b in secrets.novel_spans(text, [])] == [token]
        assert found >= least, (letters, n)
    words = "internationalisation responsibilities characterisation uncharacteristically misunderstanding telecommunications Straightforwardness recommendations acknowledgement implementations"
    assert [w for w in words.split() if secrets.novel_spans(f"the key {w} stands here among other words of the text", [])] == []


def test_text_before_a_token_is_what_it_follows(monkeypatch):
    seen = []
    monkeypatch.setattr(secrets, "is_novel", lambda token, around: seen.append((token, around)))
    secrets.novel_spans("auth header = " + "A2" * 12 + " and after", [])
    assert seen == [("A2" * 12, " and afterauth header = ")]


def test_candidates_beside_base_spans():
    g, spans, text = random.Random(3), [], ""
    for k in range(60):
        token = "".join(g.choices(string.ascii_letters + string.digits, k=30))
        spans += [(len(text), 0, len(text) + 44)] if k % 3 == 0 else []
        text += f"the auth key {token} \n"
    shown = {text[a:b] for a, _, b in secrets.novel_spans(text, spans)}
    assert len(shown) == 40 and not any(s < text.index(t) + 30 and text.index(t) < e for t in shown for s, _, e in spans)


def test_long_names_are_not_novel():
    g, words = random.Random(5), secrets.IDENTIFIERS.split()[:-6]
    for n in (4, 10, 40, 400):
        text = f"auth header = {'_'.join(g.choices(words, k=n))}_v2\n"
        assert secrets.novel_spans(text, []) == []


def test_agreement_of_documents(spark, small):
    mean = lambda vs: sum(SequenceMatcher(None, a or "", b or "").ratio() for a, b in combinations(vs, 2)) / 3
    docs, items = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("documents", "benchmark"))
    got = {r.doc_id: r.agreement for r in engine.variant_agreement(spark, small).collect()}
    assert set(got) == {r.doc_id for r in docs.select("doc_id").collect()}
    some = recognise.variants(docs.where("doc_id % 10 = 0 or length(text) > 5000")).collect()
    assert some and all(got[r.doc_id] == mean(r.variants) for r in some)
    golden = recognise.variants(items.select(F.col("item_id").alias("doc_id"), "text")).select("variants", ensemble.agreement(F.col("variants")).alias("a")).collect()
    assert golden and all(r.a == mean(r.variants) for r in golden)
