"""Quotes in regions against a plain search through every view, and every mode by name."""

from __future__ import annotations

import random

from tracelode.operators import quote_views as qv

NAMES = {"n": "\n", "t": "\t", "r": "\r", '"': '"', "'": "'", "\\": "\\", "/": "/"}


def _hits(text, needle):
    return [i for i in range(len(text) - len(needle) + 1) if text.startswith(needle, i)]


def _walk(text):
    """One layer of escapes decoded, character by character, with places."""
    out, places, i = [], [], 0
    while i < len(text):
        places.append(i)
        two = text[i] == "\\" and text[i + 1 : i + 2] in NAMES and i + 1 < len(text)
        out.append(NAMES[text[i + 1]] if two else text[i])
        i += 2 if two else 1
    return "".join(out), [*places, len(text)]


def _squeeze(text):
    out, places = [], []
    for i, c in enumerate(text):
        if c.isspace() and i and text[i - 1].isspace():
            continue
        out.append(" " if c.isspace() else c)
        places.append(i)
    return "".join(out), [*places, len(text)]


def plainly(text, quote, close):
    quote = quote.rstrip("\n") if quote.strip() else quote
    line = lambda i: text.count("\n", 0, i)
    view, places = _walk(text)
    plain = _walk(quote)[0]
    ways = [("", [(i, i + len(quote)) for i in _hits(text, quote)] if quote else [])]
    ways.append(("decoded ", [(places[i], places[i + len(quote)]) for i in _hits(view, quote)] if quote and "\\" in text else []))
    ways.append(("unescaped ", [(i, i + len(plain)) for i in _hits(text, plain)] if plain and plain != quote else []))
    prefix, spans = next(((p, s) for p, s in ways if s), ("", []))
    if len(quote) < 8:
        return ("short", line(spans[0][0]) + 1, line(spans[0][1] - 1) + 1, 1) if quote.strip() and len(spans) == 1 and not prefix else ("refused: short", None, None, len(spans))
    bounds = [(line(s), line(e - 1)) for s, e in spans]
    own = text.split("\n")
    if spans:
        first, last = min(b[0] for b in bounds), max(b[1] for b in bounds)
        body = all(own[i][:1] in ("+", "-", " ") and own[i] and not own[i].startswith(("+++ ", "--- ")) for a, b in bounds for i in range(a, b + 1))
        heads = any(own[i].startswith(("@@", "diff --git ")) for i in range(first, last + 1))
        way = "inside" if len(spans) == 1 else "same lines" if len(set(bounds)) == 1 else "diff hunk" if body and not heads and last - first < 20 else "close repeats" if close and last - first < 3 else None
        if way:
            return prefix + way, first + 1, last + 1, len(spans)
    flat, at = _squeeze(text)
    needle = _squeeze(quote)[0]
    found = _hits(flat, needle) if needle.strip() else []
    slip, mode = None, ""
    if len(found) == 1:
        slip, mode = [(at[found[0]], at[found[0] + len(needle)])], "white space"
    if slip is None:
        pieces = [p.strip() for p in quote.replace("…", "...").split("...")]
        if len(pieces) > 1 and min(map(len, pieces)) >= 8:
            each = [_hits(text, p) for p in pieces]
            if all(len(h) == 1 for h in each) and all(a[0] + len(p) <= b[0] for a, b, p in zip(each, each[1:], pieces)):
                slip, mode = [(h[0], h[0] + len(p)) for h, p in zip(each, pieces, strict=True)], "ellipsis"
    if slip is None:
        for n in range(min(len(quote), len(text), 2000), max(20, -(-len(quote) * 4 // 5)) - 1, -1):
            if h := _hits(text, quote[:n]):
                if len(h) == 1 and text[h[0] + n : h[0] + n + 1] in ("", "\n"):
                    slip, mode = [(h[0], h[0] + n)], "tail"
                break
    if slip:
        return mode, min(line(s) for s, _ in slip) + 1, max(line(e - 1) for _, e in slip) + 1, len(slip)
    return ("refused: several" if spans else "refused: not found"), None, None, len(spans)


def _text(draw):
    words = ["alpha", "beta", 'say \\"no\\"', 'say "no"', "a\\tb", "+x", "gamma  delta", "é", "\\", "\\\\n"]
    own = [draw.choice(["", "+", "-", " ", "@@ ", "--- ", "\t"]) + " ".join(draw.choices(words, k=draw.randint(0, 6))) for _ in range(draw.randint(1, 12))]
    return "\n".join(draw.choice([own, own + own[-2:], own * 2]))


def test_resolution_equals_the_plain_search():
    draw, seen = random.Random(12), set()
    for _ in range(400):
        text, asked = _text(draw), []
        for _ in range(12):
            a = draw.randrange(len(text) + 1)
            quote = text[a : a + draw.choice([3, 8, 12, 25, 60])]
            quote = draw.choice([quote, quote, _walk(quote)[0], quote.replace('"', '\\"'), quote.replace(" ", "  "), quote + " beyond", quote + "...  " + text[a + 70 : a + 90], quote + "\n", "nowhere to be seen", ""])
            asked.append((quote, draw.random() < 0.5))
        for (quote, close), found in zip(asked, qv.resolve(text, asked), strict=True):
            assert found[:4] == plainly(text, quote, close), (text, quote, close)
            seen.add(found[0])
    base = {"inside", "same lines", "diff hunk", "close repeats"}
    assert seen >= base | {"decoded inside", "unescaped inside", "short", "white space", "ellipsis", "tail", "refused: short", "refused: several", "refused: not found"}


def test_spans_lie_in_the_source():
    text = 'one\nsay \\"hello there\\" twice\n- old value here\n+ old value here\nwide   space   words\nfirst piece of it\nskipped\nsecond piece of it'
    asked = ['say "hello there" twice', "old value here", "wide space words", "first piece of it ... second piece of it", "wide   space   words and"]
    found = qv.resolve(text, [(q, False) for q in asked])
    cut = [[text[s:e] for s, e in f[4]] for f in found]
    assert cut == [['say \\"hello there\\" twice'], ["old value here"] * 2, ["wide   space   words"], ["first piece of it", "second piece of it"], ["wide   space   words"]]
    assert [f[0] for f in found] == ["decoded inside", "diff hunk", "white space", "ellipsis", "tail"]


def test_a_hot_region_and_awkward_rows(spark, monkeypatch):
    """1,200 quotes of one region, in blocks; nulls, repeated rows, regions that are not there."""
    monkeypatch.setattr(qv, "BLOCK", 50)
    text = "\n".join(f"line number {i} of the text" for i in range(1500))
    rows = [(i, 1, f"line number {i} of the text", True) for i in range(1200)] + [(5000, 1, None, None), (5001, None, "line number 3 of", True), (5002, 9, "not there at all", False), (5003, 2, "anything here", False), (None, 1, "", True), (7, 1, "line number 7 of the text", True), (5004, 3, "x" * 100_000, False)]
    quotes = spark.createDataFrame(rows, "quote_id long, region_id long, quote string, close boolean")
    regions = spark.createDataFrame([(1, text, "q"), (2, None, "q"), (3, "x" * 100_000 + "\n" + "y" * 3_000_000, "q")], "region_id long, text string, quote string")
    found = sorted(((r["quote_id"], r["mode"], r["first_line"]) for r in qv.resolve_in_regions(quotes, regions).collect()), key=repr)
    wanted = [(i, "inside", i + 1) for i in range(1200)] + [(7, "inside", 8), (5000, "refused: short", None), (5001, "refused: not found", None), (5002, "refused: not found", None), (5003, "refused: not found", None), (None, "refused: short", None), (5004, "inside", 1)]
    assert found == sorted(wanted, key=repr)
    assert qv.resolve_in_regions(quotes.where("false"), regions).count() == 0


def test_white_space_is_collapsed_only_where_it_decides(monkeypatch):
    from tracelode.operators import quote_views

    seen, collapsed = [], quote_views.collapsed
    monkeypatch.setattr(quote_views, "collapsed", lambda text: seen.append(text) or collapsed(text))
    assert quote_views.resolve("a quote that\n\n  stands here", [("a quote that", True)])[0][0] == "inside" and not seen
    assert quote_views.resolve("a quote that\n\n  stands here", [("that stands here", True)])[0][:3] == ("white space", 1, 3) and len(seen) == 1
