"""SimHash near-dedup and line dedup against plain versions."""

import random
import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from emberlake.llm import linededup, simhash
from emberlake.llm.graph import components
from tests.llm.conftest import prose


def plain_fingerprint(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    runs = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64(r.encode(), seed=42).intdigest() for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(values):
    left, out = set(values), {}
    while left:
        todo, group = [left.pop()], []
        while todo:
            group.append(x := todo.pop())
            near = {y for y in left if bin(x ^ y).count("1") <= 3}
            left -= near
            todo += near
        out |= dict.fromkeys(group, frozenset(group))
    return out


def test_near_duplicates(docs, texts):
    found = simhash.near_duplicates(docs).collect()
    prints = {i: plain_fingerprint(t) for i, t in texts}
    groups = plain_components(set(prints.values()))
    first = {g: min(i for i, p in prints.items() if p in g and i is not None) for g in set(groups.values())}
    assert len(found) == len(texts)
    for r in found:
        assert r.fingerprint == f"{prints[r.doc_id]:016x}" and r.component_id == first[groups[prints[r.doc_id]]]


def test_upper_case_beyond_ascii_stays():
    assert simhash.fingerprint("ÄB İ x") == plain_fingerprint("ÄB İ x") != simhash.fingerprint("äb i̇ x")


def test_crowded_variants_are_cut_further(spark):
    rng = np.random.default_rng(5)
    base, made = 0x1234567890ABCDEF, set()
    for _ in range(6000):
        x = base
        for b in rng.integers(0, 64, rng.integers(0, 6)):
            x ^= 1 << int(b)
        made.add(x)
    made |= {int(x) for x in rng.integers(0, 1 << 62, 500)}
    fps = np.array(sorted(made), np.uint64).view(np.int64)
    found = {r.node: r.root for r in components(simhash.links(spark.createDataFrame([(int(x),) for x in fps], "fp long"), limit=2048)).collect()}
    groups = plain_components(made)
    for g in set(groups.values()):
        signed = [int(np.array([x], np.uint64).view(np.int64)[0]) for x in g]
        assert {found.get(x) for x in signed} == ({min(signed)} if len(signed) > 1 else {None})


def test_one_of_each(spark, docs, texts):
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    found = simhash.near_duplicates(docs)
    want = {r.doc_id for r in found.where("doc_id = component_id").collect()}
    assert sorted(r.doc_id for r in kept.select("doc_id").collect()) == sorted(want)


def test_one_of_each_drops_rows_and_not_ids(spark):
    a, b = "the quick brown fox jumps over it", "nothing of this stands anywhere else at all"
    rows = [(3, a), (5, a), (5, b), (5, b), (None, a), (None, "alone " * 5), (None, "alone " * 5)]
    kept = simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(tuple, kept.collect()), key=repr) == sorted([(3, a), (5, b), (None, "alone " * 5)], key=repr)


def test_no_documents(empty):
    assert simhash.near_duplicates(empty).count() == 0 and simhash.one_of_each(empty).count() == 0


def pages(spark):
    rows = [(k, "h", f"common\n own {k}\n\n common ", 1) for k in range(10)] + [(20, "h", None, 1), (21, "h", "", 1), (22, "h", "common", 1), (22, "h", "common", 1)]
    rows += [(30, "few", "a\nb", 1), (31, "few", "a\nc", 1), (40, None, "x\ny", 1), (41, None, "x\nz", 1), (42, None, "x", 1), (50, "", "x", 1)]
    return spark.createDataFrame(rows, "page_id int, host string, text string, n_lines int")


def test_line_dedup(spark):
    for bound in (200_000, 0):  # broadcast, and the shuffled join
        found = {r.page_id: (r.text, r.n_lines, r.n_dropped) for r in linededup.drop_boilerplate(pages(spark), 0.5, 3, bound).collect()}
        assert found[3] == (" own 3\n", 3, 2) and found[20] == (None, 0, 0) and found[21] == ("", 0, 0) and found[22] == ("", 1, 1)
        assert found[30] == ("a\nb", 2, 0) and found[40] == ("y", 2, 1) and found[42] == ("", 1, 1) and found[50] == ("x", 1, 0)
    kept = {r.page_id: r.text for r in linededup.drop_boilerplate(pages(spark), 0.5, 3, keep_emptied=True).collect()}
    assert kept[22] == "common" and kept[3] == " own 3\n"
    assert linededup.drop_boilerplate(pages(spark).where("false")).count() == 0


def test_hosts_and_html(spark):
    rows = spark.createDataFrame([("https://U:p@WWW.A.org:80/x",), ("nothing",), (None,)], "u string")
    assert [r.h for r in rows.select(linededup.host_of(F.col("u")).alias("h")).collect()] == ["www.a.org", "", ""]
    html = spark.createDataFrame([("<p>a<b>b</b></p><script>x</script><div>c</div><!-- d --><br/>e",)], "h string")
    assert [x for x in html.select(linededup.html_lines(F.col("h")).alias("t")).first().t.split("\n") if x] == ["ab", "c", "e"]


def test_pipeline_drops_a_line_spread_over_many_sources(spark):
    """One in a hundred documents of each of 8 sources holds the line; a line that is rarer than the ratio stays."""
    rng = random.Random(6)
    docs = []
    for k in range(4000):
        text = prose(rng, 25)
        if k // 8 % 100 == 0:
            text += "\nThis line stands in documents of every source."
        if k in (17, 1200):
            text += "\nThis line stands twice."
        docs.append((k, text, "en", f"s{k % 8}", len(text)))
    kept = corpus_pipeline.drop_boilerplate_lines(spark, spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long"), "").collect()
    texts = {r.doc_id: r.text for r in kept}
    assert len(texts) == 4000 and not any("every source" in t for t in texts.values()) and all("stands twice" in texts[k] for k in (17, 1200))
    assert all(texts[k] == "\n".join(x for x in t.split("\n") if "every source" not in x) for k, t, *_ in docs)
