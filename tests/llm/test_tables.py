"""Mixing, URL filters, line dedup: against brute force, with awkward rows."""

import hashlib
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from curveloom.llm import lines, mixing, urls

BLANKS = " \t\n\x0b\x0c\r"
LOWER = {i: i + 32 for i in range(65, 91)}


def size_of(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def test_mix_meets_its_targets(corpus, corpus_rows, clashing):
    rows = mixing.mix_digest(clashing(corpus)).collect()
    assert len(rows) == len(corpus_rows)
    sizes = defaultdict(int)
    for r in corpus_rows:
        sizes[r[3]] += size_of(r[1])
    total = sum(sizes.values())
    names = sorted((s for s in sizes if s is not None)) + [None]
    weights = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    targets, left, open_names = {}, 1.5 * total, set(names)
    while open_names:
        level = left / sum(weights[s] for s in open_names)
        above = {s for s in open_names if level * weights[s] > 2 * sizes[s]}
        if not above:
            targets |= {s: level * weights[s] for s in open_names}
            break
        for s in above:
            targets[s] = 2 * sizes[s]
            left -= 2 * sizes[s]
        open_names -= above
    full = mixing.mix(corpus).collect()
    taken = defaultdict(int)
    for r in full:
        taken[r["source"]] += r["taken"]
        assert 0 <= r["taken"] <= 2 * r["size"]
        assert r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(targets[r["source"]])
    for s in names:
        assert abs(taken[s] - targets[s]) <= 0.02 * targets[s] + 2 * mixing.BLOCK
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix_digest(corpus.repartition(3)).collect()))


def test_apportionment_is_by_highest_quotients(spark):
    import random

    rng = random.Random(3)
    rows, wanted = [], {}
    for group in range(12):
        votes = [rng.choice([0, 1, 5, 17, 1000, rng.randint(1, 10**6)]) for _ in range(rng.randint(1, 9))]
        seats = rng.choice([0, 1, 3, 50, 333])
        rows += [(group, i, v, seats) for i, v in enumerate(votes)]
        quotients = sorted(((-v / (2 * k + 1), i) for i, v in enumerate(votes) if v for k in range(seats)))[:seats]
        for i, _ in enumerate(votes):
            wanted[group, i] = sum(q[1] == i for q in quotients)
    df = spark.createDataFrame(rows, "g int, p int, votes long, seats long")
    got = mixing.apportion(df, ["g"], ["p"], "votes", "seats", "won").collect()
    assert {(r["g"], r["p"]): r["won"] for r in got} == wanted


def test_small_shards_add_up(corpus):
    rows = mixing.mix(corpus, shard_docs=10).collect()
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in rows)
    by_source = defaultdict(lambda: [0, 0.0, 0])
    for r in rows:
        by_source[r["source"]][0] += r["taken"]
        by_source[r["source"]][1] = r["target"]
    for taken, target, _ in by_source.values():
        assert abs(taken - target) <= 0.05 * target + 10 * mixing.BLOCK


def test_mixed_documents_hold_the_words_taken(corpus, clashing):
    wanted = defaultdict(int)
    for r in mixing.mix(corpus).collect():
        wanted[r["doc_id"]] += r["taken"]
    mixed = mixing.mixed_documents(clashing(corpus))
    assert mixed.columns == clashing(corpus).columns
    got = defaultdict(int)
    texts = defaultdict(set)
    for r in corpus.collect():
        texts[r["doc_id"]].add(r["text"])
    for r in mixed.collect():
        got[r["doc_id"]] += size_of(r["text"])
        assert any(r["text"] in t for t in texts[r["doc_id"]] if t)
    assert {k: v for k, v in wanted.items() if v} == dict(got)


def test_mix_of_nothing(spark, empty):
    assert mixing.mix_digest(empty).count() == 0
    assert mixing.mixed_documents(empty).count() == 0
    blank = spark.createDataFrame([(1, None, None), (2, " ", "a")], "doc_id long, text string, source string")
    assert [r["taken"] for r in mixing.mix_digest(blank).collect()] == [0, 0]


def dedup_by_hand(rows):
    holders = defaultdict(set)
    key = lambda line: line.strip(BLANKS).translate(LOWER)
    for doc_id, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= 40:
                holders[key(line)].add(doc_id)
    last = {k: max((d for d in v if d is not None), default=None) for k, v in holders.items() if len(v) >= 5}
    out = []
    for doc_id, text in rows:
        split = (text or "").split("\n")
        kept = [x for x in split if key(x) not in last or last[key(x)] == doc_id]
        out.append((str(doc_id), len(split), len(split) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("batches, fanout", [(1, 4), (4, 4), (5, 2)])
def test_line_dedup(corpus, corpus_rows, batches, fanout):
    out = lines.drop_repeated_lines(corpus, batches=batches, fanout=fanout).select(
        "doc_id", "n_lines", "n_dropped", F.sha2(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), 256).alias("s")).collect()
    got = sorted((str(r["doc_id"]), r["n_lines"], r["n_dropped"], r["s"]) for r in out)
    assert got == dedup_by_hand([(r[0], r[1]) for r in corpus_rows])
    assert sum(r[2] for r in got) > 50


def test_line_dedup_keeps_columns_and_takes_nothing(corpus, empty, clashing):
    out = lines.drop_repeated_lines(clashing(corpus))
    assert set(clashing(corpus).columns) <= set(out.columns)
    assert out.count() == corpus.count()
    assert lines.line_digest(empty).count() == 0
    assert lines.drop_repeated_lines(corpus.where("text is null")).where("text is not null").count() == 0


def test_runs_are_levelled(corpus):
    found = lines.line_hashes(corpus)
    runs = lines.LineRuns(fanout=2)
    parts = [found.where(F.pmod(F.xxhash64("doc_id"), F.lit(5)) == i) for i in range(5)]
    for part in parts[:4]:
        runs.add(part)
    assert [len(level) for level in runs.levels] == [0, 0, 1]
    unseen = runs.unseen(parts[4]).select("key_a").distinct().count()
    known = {r[0] for p in parts[:4] for r in p.select("key_a").collect()}
    assert unseen == len({r[0] for r in parts[4].select("key_a").collect()} - known)
    runs.add(parts[4])
    assert len(runs.runs) == 2


def judge_by_hand(rows, listed):
    out = []
    for page_id, url in rows:
        host = path = ""
        if url is not None and "://" in url:
            rest = url.split("://", 1)[1]
            host = re.match(r"[^/?#]*", rest)[0].translate(LOWER)
            path = re.match(r"[^?#]*", rest[len(host):])[0]
        fitting = [(len(h + p), h + p, v) for h, p, v in urls.RULES
                   if (host == h or host.endswith("." + h)) and path.startswith(p)]
        rule, verdict = max(fitting)[1:] if fitting else (None, None)
        name = re.sub(r"^(www|m)\.", "", re.sub(r":[0-9]*$", "", host)) + re.sub(r"/+$", "", re.sub(r"\.html$", "", path))
        out.append((page_id, host, path, rule, verdict or ("block" if name and name in listed else "allow")))
    return sorted(out, key=str)


URLS = [
    "http://www.Spam.NET/a.html?x=1", "https://spam.net:8080/a/", "m.spam.net/a", None, "", "http://", "://x", "ftp://spam.net",
    "http://a.example.org/es/1", "http://example.org/en/12", "http://example.org/en/2", "http://notexample.org/es/", "http://org/x",
    "http://x.com/fr/1#top", "http://x.com/de/1", "http://x.com", "http://x.org", "http://x.com?/fr/", "HTTP://X.COM/FR/", "http://a://b/c",
    "http://spam.net/ä%20b", "http://\nx.net/y", "http://spam.net/a" + "b" * 5000,
]


def test_urls(spark, clashing):
    rows = [(i, u) for i, u in enumerate(URLS)] + [(100 + i, "http://www.spam.net/a#x") for i in range(50)] + [(0, URLS[0])]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    listed = spark.createDataFrame([("spam.net/a",), ("spam.net/a",), ("x.com",), (None,), ("",)], "canonical string")
    got = urls.judge_urls(clashing(pages), listed).collect()
    names = ("page_id", "host", "path", "rule", "verdict")
    assert sorted((tuple(r[n] for n in names) for r in got), key=str) == judge_by_hand(rows, {"spam.net/a", "x.com"})
    nothing = urls.judge_urls(pages.limit(0), listed)
    assert nothing.count() == 0
    unlisted = urls.judge_urls(pages, listed.limit(0)).collect()
    assert sorted((tuple(r[n] for n in names) for r in unlisted), key=str) == judge_by_hand(rows, set())


def test_filter_has_all_hits_and_few_others(spark):
    listed = spark.range(5000).select(F.concat(F.lit("in/"), "id").alias("canonical"))
    others = spark.range(20000).select(F.concat(F.lit("out/"), "id").alias("canonical"))
    assert urls.possible_hits(listed, "canonical", listed).count() == 5000
    assert urls.possible_hits(others, "canonical", listed).count() < 200
