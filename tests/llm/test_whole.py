"""Cases that were left out once: what stands here must be found, counted and told apart as a whole."""

from __future__ import annotations

import random

import pyarrow as pa
import pytest

from tracelode.llm import language_id, secret_scan

HEX = "f33e61083db5dbdf4bd2369d2f80176e57f7fda2"


def _cut(text: str) -> list[tuple[str, str]]:
    found = secret_scan.candidates(pa.array([text]), [None])[0]
    assert all(text.encode()[f.start : f.end].decode() == f.value for f in found)
    assert all(a.end <= b.start for a, b in zip(found, found[1:]))
    return [(f.value, f.name) for f in found]


@pytest.mark.parametrize(
    ("text", "value", "name"),
    [
        (f"“{HEX}”", HEX, ""), (f"«token={HEX}»", HEX, "token"), (f"mot_clé={HEX}", HEX, "mot_clé"), (f"密钥{HEX}在这里", HEX, ""), (f'"token":"{HEX}"', HEX, "token"),
        (f"'api_key':'{HEX}',", HEX, "api_key"), (f'"x","{HEX}"', HEX, ""), (f'{{"id":"x","token":"{HEX}","b":1}}', HEX, "token"), (f"http://a.b/c?a=1&token={HEX}&z=2", HEX, "token"),
        (f'{{\\"token\\":\\"{HEX}\\"}}', HEX, "token"), (f"a\\ntoken={HEX}\\n", HEX, "token"), (f"a%26token%3D{HEX}", HEX, "token"), ("password=hunter2", "hunter2", "password"), ("token: abcdefghijklmnop", "abcdefghijklmnop", "token"),
        ('"password":"aB3$,x(9&k"', "aB3$,x(9&k", "password"), ("Bearer abcDEFghiJKLmnoPQRstu", "abcDEFghiJKLmnoPQRstu", ""), ("secret = dGhpcyBpcyBhIHNlY3JldDEyMw==", "dGhpcyBpcyBhIHNlY3JldDEyMw==", "secret"),
    ],
)
def test_secrets_become_candidates(text, value, name):
    assert (value, name) in _cut(text)


def test_several_candidates_a_word():
    other = HEX[::-1]
    assert _cut(f'{{"token":"{HEX}","secret":"{other}","n":1}}') == [(HEX, "token"), (other, "secret")]
    assert _cut("no candidates here: don't look, author: Smith, 3.14") == []


def test_compact_secrets_are_replaced(spark):
    lines = [f'{{"id":"x","token":"{HEX}","b":1}}', f"http://a.b/c?a=1&token={HEX}&z=2", f"这里的token={HEX}在这里", f"«token={HEX}»"]
    plain = ["the secret garden is green and the key of the house is old", f"commit {HEX} of the house"]
    docs = spark.createDataFrame([(i, t, "src", len(t)) for i, t in enumerate(lines + plain)], "doc_id long, text string, source string, n_chars long")
    rows = {r["doc_id"]: r for r in secret_scan.scan_documents(docs, secret_scan.fit(docs), with_text=True).collect()}
    for i, text in enumerate(lines):
        assert rows[i]["clean"] == text.replace(HEX, "[secret]")
    assert all(rows[len(lines) + i]["clean"] == text for i, text in enumerate(plain))


def test_dictionary_counts_whole_texts_of_all_documents(spark):
    late = "x " * 10_001 + "latecomer " * 50  # beyond the first 20,000 characters
    rows = [(0, late), (1, None)] + [(i, "common words") for i in range(2, 40)] + [(i, "Straggler") for i in range(40, 1000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert secret_scan.frequent_words(docs) == ["straggler", "latecomer", "common", "words"]
    assert secret_scan.frequent_words(docs.where("false")) == []
    finding = secret_scan.labelled_findings(["alpha"], 100)
    assert secret_scan.fit(docs, finding).dictionary == {"straggler", "latecomer", "common", "words"}


def test_every_language_is_told(spark, monkeypatch):
    """70 languages, each with words of its own; also when they are scored group by group."""
    draw = random.Random(4)
    words = ["".join(draw.choices("abcdefghijklmnopqrstuvwxyz", k=9)) for _ in range(70)]
    docs = spark.createDataFrame([(f"{w} " * (3 + i), f"l{i:02d}") for i, w in enumerate(words)], "text string, lang string").repartition(3)
    pages = spark.createDataFrame([(i, None, f"<p>{w} {w} {w} {w} {w}</p>") for i, w in enumerate(words)] + [(0, None, f"<p>{words[0]} {words[0]} {words[0]} {words[0]} {words[0]}</p>")], "page_id long, url string, html string")
    rows = lambda: sorted((r["page_id"], r["text_language"], r["language"], r["probability"]) for r in language_id.identify_pages(pages, docs).collect())
    at_once = rows()
    assert len(at_once) == 71 and all(own == told == f"l{i:02d}" for i, own, told, _ in at_once)
    monkeypatch.setattr(language_id, "LANGUAGES_AT_ONCE", 29)
    assert rows() == at_once


def test_markup_goes_in_one_walk():
    """As the plain pattern says, and in time that grows with the page, whatever is left open."""
    import re
    import time

    plain = re.compile(r"<!--.*?-->|<(script|style|noscript)\b.*?</\1\s*>|<[^>]*>", re.S | re.I)
    draw = random.Random(1)
    parts = ["<script>", "</script>", "</SCRIPT  >", '<style a="1">', "</style>", "<!--", "-->", "<", ">", "text ", "<p>", "<scripty>", "</p", "\n", "<noscript", "</noscript>", "é", "-", "<!-->", "/"]
    for _ in range(4000):
        page = "".join(draw.choices(parts, k=draw.randint(0, 14)))
        assert language_id._without_markup(page) == plain.sub(" ", page), page
    began = time.monotonic()
    for part in ("<script>", "<!-- x", "<style><p>", "<", "</script", "<script></script "):
        language_id._without_markup(part * (1_000_000 // len(part)))
    assert time.monotonic() - began < 30
