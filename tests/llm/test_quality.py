import re
from collections import Counter

from pathweave.llm.quality import clean_lines, keep_clean, line_rule, op7_quality_rules
from tests.llm.conftest import as_dir

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    count, inside = Counter(windows), set()
    for i, w in enumerate(windows):
        if count[w] > 1:
            inside |= set(range(i, i + 8))
    seen, dup = set(), 0
    for line in text.split("\n"):
        dup += bool(WORD.search(line)) and line in seen
        seen.add(line)
    failed = len(words) < 20 or 100 * len(inside) > 30 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(inside), failed


def test_query_matches_brute_force(spark, docs, texts, words, tmp_path):
    more = [" ".join(words[:12] * 3), " ".join(words[:8] * 2 + words[50:99]), "### a\n### a\n&é é|<", "\n".join([" ".join(words[:9])] * 4)]
    frame = docs.select("doc_id", "text").union(spark.createDataFrame([(1000 + i, t) for i, t in enumerate(more)], "doc_id long, text string"))
    every = dict(enumerate(texts)) | {1000 + i: t for i, t in enumerate(more)}
    got = op7_quality_rules(spark, as_dir(frame, tmp_path)).collect()
    assert len(got) == len(every)
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute(every[r.doc_id])
        assert not (r.base_failed and r.kept)


def test_lines():
    assert line_rule("Home | News | Shop | Help") == "navigation"
    assert line_rule("Th### of*** and&&& la%%%") == "symbols"
    assert line_rule("THIS IS ALL TOO LOUD HERE") == "shouting"
    assert line_rule("We use cookies.") == "boilerplate"
    assert line_rule("A plain sentence with a | bar and 5 % of C# in it.") is None
    assert clean_lines("good line\nHome | News | Shop\ngood line\n\nend") == ("good line\n\nend", 1, 2, 7)


def test_keep_clean_keeps_columns(docs, empty, nulls):
    out = keep_clean(docs)
    assert out.columns == docs.columns
    rows = out.collect()
    assert rows and all(r.n_chars == len(r.text) for r in rows)
    assert keep_clean(empty).count() == 0 and keep_clean(nulls).count() == 0


def test_good_documents_stay_and_junk_goes(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id")
    kept = {r.doc_id for r in keep_clean(d).select("doc_id").collect()}
    rows = d.select("doc_id", "quality", "text").collect()
    good = [r for r in rows if r.quality == 1 and len(r.text.split()) >= 20]
    junk = [r for r in rows if r.quality == 0]
    assert sum(r.doc_id in kept for r in good) >= 0.99 * len(good)
    assert sum(r.doc_id in kept for r in junk) <= 0.05 * len(junk)
