"""Fill-in-the-middle against a plain version, in one chunk and in many."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpus import documents, texts
from tracelode.llm import fill_middle

MARKED = ["a<P>b", "<<S>", "<M", "x<p>y", "<P", "<", "ab<", "<Pq>", "<<<M>>>", "<S", "é<M>é"]


def plainly(doc_id, text):
    text = text or ""
    unit = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    n = len(unit)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(unit[:low]), "".join(unit[low:high]), "".join(unit[high:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return doc_id, n, "plain", None, None, text, text
    if h[3] % 100 < 20:
        return doc_id, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}", text
    return doc_id, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}", text


def _rows(docs):
    made = fill_middle.fill_in_middle(docs).withColumn("back", fill_middle.restored(F.col("output"), F.col("form")))
    return sorted((tuple(r) for r in made.collect()), key=repr)


@pytest.mark.parametrize("chunk", [1 << 16, 300, 7])
def test_forms_of_awkward_texts(spark, monkeypatch, chunk):
    monkeypatch.setattr(fill_middle, "CHUNK", chunk)
    rows = texts() + [(100 + i, t) for i, t in enumerate(MARKED)] + [(200 + i, "don't <stop> " * i + "日本<語") for i in range(40)]
    rows += rows[10:14]
    assert _rows(documents(spark, rows)) == sorted((plainly(i, t) for i, t in rows), key=repr)


def test_no_rows(spark):
    assert _rows(documents(spark, [])) == []


def test_a_whole_table(spark, tiny, monkeypatch):
    table = spark.read.parquet(f"{tiny}/documents.parquet")
    wanted = sorted((plainly(r["doc_id"], r["text"]) for r in table.collect()), key=repr)
    assert {w[2] for w in wanted} == {"plain", "psm", "spm"}
    assert _rows(table) == wanted
    monkeypatch.setattr(fill_middle, "CHUNK", 1000)
    assert _rows(table) == wanted


def test_functions_compose_like_one_run():
    """However a text is cut, composing the parts' functions gives that of the whole, from every state."""
    draw = random.Random(3)
    for _ in range(50):
        text = "".join(draw.choice("aPSM<> é日-") for _ in range(draw.randint(0, 900))).encode()
        cut = sorted(draw.randint(0, len(text)) for _ in range(3))
        parts = [text[a:b] for a, b in zip([0, *cut], [*cut, len(text)], strict=True)]
        state, count = fill_middle.Scan(parts).functions()
        whole = fill_middle.Scan([text]).functions()
        joined = fill_middle.composed((state, count), np.arange(4))
        assert (joined[0][-1] == whole[0][0]).all() and (joined[1][-1] == whole[1][0]).all()
        assert fill_middle.units(whole[1][0, 0]) == len(re.findall("[A-Za-z]+|[^A-Za-z]", text.decode()))
        assert fill_middle.markers(whole[1][0, 0]) == len(re.findall("<[PSM]>", text.decode()))


def test_a_giant_document_is_many_tasks(spark):
    """A document of 3 MB: every chunk is scanned apart, and the cuts are right."""
    draw = random.Random(8)
    text = " ".join("".join(draw.choices("abcdé", k=draw.randint(1, 9))) for _ in range(450_000))
    rows = [(i, text) for i in range(3)] + [(9, "y" * 200_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert _rows(docs) == sorted((plainly(i, t) for i, t in rows), key=repr)
