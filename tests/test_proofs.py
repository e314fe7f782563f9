"""Operators that search by rare keys or fold by aggregates, against the plain rule on small random tables."""

import datetime
import math
import random
import re
import threading
from difflib import SequenceMatcher
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from reelmine.operators import cards, catalog, corpus, merges, reports, search
from reelmine.plans import staging


def slid(a, t, wide):
    """The first best window of all, by the plain ratio."""
    best, span, size = 0.0, None, len(a)
    for i in range(0, max(len(t) - size, 1), max(size // 4, 1)):
        r = SequenceMatcher(None, a, t[i : i + int(size * wide)]).ratio()
        if r > best:
            best, span = r, t[i : i + int(size * wide)]
    return best, span


def test_best_windows_against_the_full_slide():
    rng, letters = random.Random(9), "abcde fgh"
    for case in range(120):
        t = "".join(rng.choice(letters[: rng.randint(2, 9)]) for _ in range(rng.choice((0, 1, 7, 200, 900))))
        at, n = rng.randint(0, max(0, len(t) - 1)), rng.randint(1, 70)
        a = list(t[at : at + n] or "abc")
        for _ in range(rng.randint(0, len(a) // 3)):
            a[rng.randrange(len(a))] = rng.choice(letters + "é")
        a, known = "".join(a), cards.Windows(t)
        for wide, least in ((1.4, cards.NEAR), (1.6, cards.REPAIR), (1.4, 0.2)):
            best, span = slid(a, t, wide)
            assert known.best(a, wide, least) == ((best, span) if best >= least else (0.0, None)), (case, a, t)


def test_anchors_are_judged_gated_and_repaired(spark):
    body = "we learned to place the stop below the swing low and never to move it further away from the entry price"
    rows = [("EV-000001", 1, body[3:40]), ("EV-000002", 1, "place the stop below the swung low and never"), ("EV-000003", 1, "qqqq zzzz xxxx jjjj"), ("EV-000004", 1, "learned to place ... further away"), ("EV-000005", 2, "anything"), ("EV-000006", 1, None)]
    df = spark.createDataFrame(rows, "id string, video_id long, anchor string")
    checked = cards.check_anchors(df, spark.createDataFrame([(1, body)], "video_id long, body string"))
    assert {r.id[-1]: r.verdict for r in checked.collect()} == {"1": "exact", "2": "near", "3": "missing", "4": "fragments", "5": "no transcript", "6": "missing"}
    assert {r.verdict: r.anchors for r in cards.verdict_counts(checked).collect()} == {"exact": 1, "near": 1, "missing": 2, "fragments": 1, "no transcript": 1}
    assert [tuple(cards.anchor_gate(checked, limit).first()) for limit in (59.9, 60.0)] == [(5, 3, 60.0, "FAIL"), (5, 3, 60.0, "PASS")]
    assert tuple(cards.anchor_gate(checked.limit(0), 5.0).first())[:2] == (0, 0)
    mended = {r.id[-1]: (r.anchor, r.anchor_repaired) for r in cards.repair_anchors(df, checked).collect()}
    assert mended["2"] == ("place the stop below the sw", True) and mended["2"][0] in body
    assert all(mended[r[0][-1]] == (r[2], False) for r in rows if not r[0].endswith("2"))
    again = cards.check_anchors(cards.repair_anchors(df, checked), spark.createDataFrame([(1, body)], "video_id long, body string"))
    assert {r.verdict for r in again.where("id = 'EV-000002'").collect()} == {"exact"}


def test_contradictions_against_all_pairs(spark):
    rng, words = random.Random(4), [f"word{c}" for c in "abcdefghijkl"]
    rows = []
    for i in range(160):
        said = rng.choices(words, weights=range(12, 0, -1), k=rng.randint(1, 7))
        rows.append((f"EV-{i:06d}", i % 40, rng.choice(["rule", "number", "opinion"]), sorted(rng.sample(["t1", "t2", "t3"], rng.randint(0, 2))), " ".join(said) + rng.choice([" never", ""])))
    df = spark.createDataFrame(rows, "id string, video_id long, type string, topics array<string>, claim string")
    got = {(r.topic, r.a, r.b, tuple(r.shared)) for r in cards.contradictions(df).collect()}
    want = {}
    for a, va, ta, topics_a, ca in rows:
        for b, vb, tb, topics_b, cb in rows:
            if a < b and va != vb and {ta, tb} <= {"rule", "number"} and ("never" in ca) != ("never" in cb):
                shared = sorted(set(re.findall("[a-z]{5,}", ca)) & set(re.findall("[a-z]{5,}", cb)))
                for t in sorted(set(topics_a) & set(topics_b)):
                    if len(shared) >= 3:
                        want.setdefault((a, b), (t, a, b, tuple(shared[:6])))
    assert got == set(want.values()) and len(got) > 50


@pytest.mark.parametrize("least", [0.1, 0.25, 0.9, 1.0])
def test_contained_clips_against_all_pairs(spark, least):
    rng = random.Random(6)
    text = lambda n: [f"w{int(rng.paretovariate(0.6)) % 500}" for _ in range(n)]
    longer = [text(rng.randint(60, 120)) for _ in range(12)]
    clips = []
    for i in range(60):
        src = rng.choice(longer)
        at, n = rng.randrange(len(src) - 20), rng.randint(12, 40)
        clips.append((text(rng.randint(0, 25)) + src[at : at + n] + text(rng.randint(0, 25)))[:50])
    rows = [(i, " ".join(w)) for i, w in enumerate(longer + clips)]
    grams = {i: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for i, t in rows}
    want = {}
    for i, t in rows:
        if len(t.split()) <= 50 and len(grams[i]) >= 10:
            best = min(((-len(grams[i] & grams[j]), -len(u.split()), j) for j, u in rows if len(u.split()) > 50 and len(grams[j]) >= 10), default=None)
            if best and -best[0] >= least * len(grams[i]) and best[0]:
                want[i] = (best[2], round(-best[0] / len(grams[i]), 3))
    got = {r.clip: (r.source, r.containment) for r in corpus.contained_clips(spark.createDataFrame(rows, "video_id long, body string"), short_words=50, least=least).collect()}
    assert got == want and (want or least == 1.0)


def test_quota_passes_its_limit_at_the_right_row(spark):
    rng, start = random.Random(2), datetime.datetime(2024, 5, 1, 20)
    rows = [(i, start + datetime.timedelta(seconds=rng.randint(0, 200_000)), rng.randint(0, 30)) for i in range(3000)]
    got = {r.day: (r.units_used, r.soft_limit_at) for r in reports.quota_ledger(spark.createDataFrame(rows, "id long, started_at timestamp, units long"), 12_000).collect()}
    want = {}
    for i, at, units in sorted(rows, key=lambda r: (r[1], r[0])):
        day = (at - datetime.timedelta(hours=7)).date()
        used, passed = want.get(day, (0, None))
        want[day] = (used + units, passed or (at if used + units >= 0.9 * 12_000 else None))
    assert got == want and any(x[1] for x in want.values()) and not all(x[1] for x in want.values())


def ranked(texts, query, limit):
    words = {w for w in query.lower().split() if len(w) >= 3}
    df = {w: sum(w in t.split() for t in texts.values()) for w in words}
    score = {v: round(sum(t.split().count(w) * math.log(1 + len(texts) / df[w]) ** 2 for w in words if df[w]), 6) for v, t in texts.items()}
    return sorted(((v, x) for v, x in score.items() if x > 0), key=lambda r: (-r[1], r[0]))[:limit]


def test_a_common_key_is_met_in_parts(spark):
    """The same pairs as a join, and no part of a hot key has much more than its share."""
    x = spark.range(5000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("key"), F.col("id").alias("a"))
    y = spark.range(0, 5000, 7).select(F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id")).alias("key"), F.col("id").alias("b"))
    met = staging.join_in_parts(x, y, ["key"], "a", 100)
    assert met.exceptAll(x.join(y, "key").select(met.columns)).isEmpty() and met.count() == x.join(y, "key").count()
    sizes = [r["count"] for r in x.where("key = 0").groupBy(F.pmod(F.xxhash64("a"), F.lit(-(-1667 // 100)))).count().collect()]
    assert len(sizes) == 17 and max(sizes) < 200
    assert staging.join_in_parts(x.limit(0), y, ["key"], "a").count() == 0 == staging.join_in_parts(x, y.limit(0), ["key"], "a").count()


def test_titles_that_share_a_common_gram(spark):
    """A third of the titles begins alike; the pairs are those of the plain ratio."""
    rng = random.Random(12)
    titles = sorted({("the best of " if i % 3 == 0 else "") + " ".join(rng.choice(["market", "orders", "trade", "plan", "risk", "gold"]) + rng.choice("abc") for _ in range(rng.randint(1, 3))) for i in range(260)})
    df = spark.createDataFrame([(t, i) for i, t in enumerate(titles)], "title string, rank int")
    got = {(r.a, r.b) for r in corpus.similar_titles(df, 0.86).collect()}
    want = set()
    for i, a in enumerate(titles):
        for b in titles[i + 1 :]:
            if abs(len(a) - len(b)) <= 0.4 * max(len(a), len(b)) and SequenceMatcher(None, a, b).ratio() >= 0.86:
                want.add((a, b))
    assert got == want and len(want) > 50


def test_an_index_follows_its_transcripts(spark, tmp_path, monkeypatch):
    """After additions, replacements and deletions it finds what plain counting over the texts finds, and old files stay as they are."""
    monkeypatch.setattr(search, "BLOCK", 8)
    rng, path = random.Random(6), f"file://{tmp_path}/i"
    words = ["alpha", "beta", "gamma", "delta", *(f"rare{i}" for i in range(40))]
    text = lambda: " ".join(rng.choices(words, weights=[60, 20, 8, 3, *[1] * 40], k=rng.randint(0, 40)))
    texts, files = {}, {}
    put = lambda rows: spark.createDataFrame(rows, "video_id long, plaintext string")
    changes = [{i: text() for i in range(600)}, {i: text() for i in range(500, 700)}, {i: None for i in range(0, 640, 7)} | {9999: None}, {7: "alpha rare1", 14: None, 650: ""}]
    for number, change in enumerate(changes):
        assert search.update_index(put(list(change.items())), path) == number
        now = _files(tmp_path / "i")
        assert all(now[f] == at for f, at in files.items())
        files = now
        texts = {v: t for v, t in (texts | change).items() if t is not None}
        for query, limit in (("alpha", 5), ("delta rare3 rare9", 20), ("alpha beta gamma", 50), ("rare1 a", 500), ("nothing", 5)):
            found = [tuple(r) for r in search.scores(spark, path, query, limit).collect()]
            assert found == ranked(texts, query, limit), (number, query)
    again = search.compact_index(spark, path, put(list(texts.items())))
    assert search.scores(spark, again, "beta delta", 30).collect() == search.scores(spark, path, "beta delta", 30).collect()
    (tmp_path / "i" / "generations" / "000000000004.json").write_text('{"generation": 3}')  # another writer took the number meanwhile
    with pytest.raises(RuntimeError, match="another writer"):
        search.update_index(put([(1, "lost")]), path)


def test_copies_of_clips_and_sources_meet_once(spark, monkeypatch):
    met, table = [], corpus.table
    monkeypatch.setattr(corpus, "table", lambda df, name: met.append((name, out := table(df, name))) or out)
    clip, more = [f"w{i}" for i in range(40)], [f"v{i}" for i in range(60)]
    rows = [(i, " ".join(clip + [f"only{i}"])) for i in range(30)] + [(100 + i, " ".join(clip + more + [f"own{i}"] * (i % 3))) for i in range(30)]
    got = corpus.contained_clips(spark.createDataFrame(rows, "video_id long, body string"), short_words=50).collect()
    assert sorted(map(tuple, got)) == [(i, 41, 102, round(36 / 37, 3)) for i in range(30)]
    assert dict(met)["clip-pairs"].count() == 1


def test_texts_are_split_once_and_counted_where_they_lie(spark, monkeypatch):
    texts = {1: "Beta beta, alpha!", 2: None, 3: "", 4: "gamma-beta 7 7 7", 5: "Éa éa"}
    rows = spark.createDataFrame(list(texts.items()), "video_id long, plaintext string")
    found = search.forward_index(rows)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    assert {r.video_id: r.terms and dict(zip(r.terms, r.tfs)) for r in found.collect()} == {1: {"beta": 2, "alpha": 1}, 2: None, 3: [], 4: {"gamma": 1, "beta": 1, "7": 3}, 5: {"éa": 2}}
    splits, tokens = [], search.tokens
    monkeypatch.setattr(search, "tokens", lambda c: splits.append(1) or tokens(c))
    path = search.write_index(rows.unionByName(spark.createDataFrame([(1, "Alpha beta")], rows.schema)))
    assert len(splits) == 1 and search.scores(spark, path, "beta").orderBy("video_id").select("video_id").collect() == [(1,), (4,)]


def test_search_takes_text_and_notes_short_words(spark):
    rows = spark.createDataFrame([(i, f"{'x ' * 200}Alpha w{i % 7} beta{i % 3}", f"t{i}", "c") for i in range(50)] + [(99, None, "none", "c")], "video_id long, plaintext string, title string, channel_id string")
    path = search.write_index(rows)
    found = search.search(path, rows, rows, "beta1 alpha no", 5).collect()
    assert len(found) == 5 and all(r.snippet.startswith("x ") and "Alpha w" in r.snippet and r.video_id % 3 == 1 for r in found)
    assert search.search(path, rows, rows, "a no").count() == 0 and search.search(path, rows, rows, "unheard").count() == 0
    assert search.search_note("beta1 alpha") is None and "no" in search.search_note("alpha no") and "cannot match" in search.search_note("a no")


def test_outcomes(spark):
    at = lambda h: datetime.datetime(2024, 5, 1) + datetime.timedelta(hours=h)
    videos = spark.createDataFrame(
        [(v, "metadata_ok", None, 1, True, at(0), None, 0, at(-48), "w", at(1)) for v in range(7)],
        "video_id long, status string, status_reason string, attempts int, needs_audio boolean, next_attempt_at timestamp, recheck_after timestamp, recheck_count int, published_at timestamp, claimed_by string, lease_expires_at timestamp",
    )
    log = [
        (1, 1, "terminal", "lang_missing", True), (1, 2, "ok", None, False), (2, 3, "terminal", "no_transcript", True), (3, 4, "retryable", None, False), (4, 5, "retryable", None, False), (4, 6, "retryable", None, False), (4, 7, "retryable", None, False), (4, 8, "retryable", None, False),
        (5, 9, "retryable", None, False), (5, 10, "blocked", None, False), (6, 11, "terminal", "age_restricted", False),
    ]
    attempts = spark.createDataFrame([(v, i, at(i), o, t, "r" * 300, t == "no_transcript", re_, 100_000 if v == 3 else None, None) for v, i, o, t, re_ in log], "video_id long, id long, started_at timestamp, outcome string, target string, reason string, needs_audio boolean, recheck boolean, retry_after long, max_attempts int")
    got = {r.video_id: r for r in merges.apply_outcomes(videos, attempts).collect()}
    assert (got[0].attempts, got[0].claimed_by, got[0].next_attempt_at) == (1, "w", at(0))
    assert (got[1].status, got[1].attempts, got[1].status_reason, got[1].needs_audio, got[1].recheck_after, got[1].lease_expires_at) == ("transcript_ok", 3, None, False, None, None)
    assert (got[2].status, got[2].needs_audio, got[2].recheck_after, len(got[2].status_reason)) == ("no_transcript", True, at(3 + 6), 255)
    assert (got[3].status, got[3].next_attempt_at, got[3].needs_audio) == ("retry", at(4) + datetime.timedelta(seconds=100_000), True)
    assert (got[4].status, got[4].attempts, got[4].next_attempt_at) == ("failed", 5, None)
    assert (got[5].status, got[5].attempts, got[5].next_attempt_at) == ("retry", 2, None)
    assert (got[6].status, got[6].needs_audio, got[6].recheck_after) == ("age_restricted", False, None)
    same = merges.apply_outcomes(videos, attempts.limit(0))
    assert same.exceptAll(videos).isEmpty() and same.count() == 7
    due = {r.video_id: (r.status, r.recheck_count) for r in merges.promote_due(merges.apply_outcomes(videos, attempts), "2024-05-02 00:00:00").collect()}
    assert due[2] == ("metadata_ok", 1) and due[6] == ("age_restricted", 0)
    assert {r.claimed_by for r in catalog.release_leases(videos, "w").collect()} == {None}


@pytest.mark.parametrize("partitions", ["1", "4", "37"])
def test_word_batches_in_order(spark, partitions):
    """Equal to the fold, whatever the blocks: hot and small phases, items without words, above the budget, and null."""
    rng = random.Random(3)
    rows = [(p, k, f"{p}{k}", rng.choice((0, 0, None, rng.randint(1, 60), 250))) for p, n in (("a", 3000), ("b", 400), (None, 300), ("c", 1)) for k in range(n)]
    rows += [("d", k, f"d{k}", w) for k, w in enumerate([0, 0, 500, 0, 0, 100, 1, 0, 99, 101, 101])]
    rng.shuffle(rows)
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = {r.video_id: r.batch for r in reports.work_batches(spark.createDataFrame(rows, "phase string, pos long, video_id string, words long"), 100).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
    want, state = {}, {}
    for p, _, v, words in sorted(rows, key=lambda r: (str(r[0]), r[1])):
        batch, total = state.get(p, (0, 0))
        words = words or 0
        batch, total = (batch + 1, words) if total > 0 and total + words > 100 else (batch, total + words)
        want[v], state[p] = batch, (batch, total)
    assert got == want


def _stored(spark, n=60):
    at = lambda h: datetime.datetime(2024, 5, 1) + datetime.timedelta(hours=h)
    rows = [(i, f"c{i % 3}", ("metadata_ok", "retry", "discovered", "transcript_ok")[i % 4], at(-i) if i % 7 else None, at(i % 5 - 2) if i % 3 else None) for i in range(n)]
    videos = spark.createDataFrame(rows, "video_id long, channel_id string, status string, published_at timestamp, next_attempt_at timestamp")
    return videos, spark.createDataFrame([("c0", True), ("c1", True), ("c2", False)], "channel_id string, is_enabled boolean")


def test_claimers_get_disjoint_sets(spark, tmp_path):
    """Six at once, again and again, until two turns in a row gave nothing: every claimable video once."""
    videos, channels = _stored(spark)
    base, now, got = f"file://{tmp_path}/c", "2024-05-01 00:00:00", {}
    catalog.claim_batch(videos, channels, base, "first", now, 0)

    def work(name):
        got[name] = []
        while batch := [r.video_id for r in catalog.claim_batch(videos, channels, base, name, now, 3, 600).collect()]:
            got[name] += batch

    workers = [threading.Thread(target=work, args=(f"w{i}",)) for i in range(6)]
    [w.start() for w in workers]
    [w.join() for w in workers]
    claimed = [v for ids in got.values() for v in ids]
    free = {r.video_id for r in videos.where("channel_id <> 'c2' and status in ('metadata_ok', 'retry') and (next_attempt_at is null or next_attempt_at <= '2024-05-01 00:00:00')").collect()}
    assert len(claimed) == len(set(claimed)) and set(claimed) == free
    leases = {r.video_id: r.claimed_by for r in merges.read_snapshot(spark, base, "leases").collect()}
    assert leases == {v: w for w, ids in got.items() for v in ids}
    held = catalog.with_leases(videos, base)
    assert {r.video_id for r in held.where("lease_expires_at = '2024-05-01 00:10:00'").collect()} == free


def test_claims_by_rule(spark, tmp_path):
    videos, channels = _stored(spark)
    now = "2024-05-01 00:00:00"
    ids = lambda base, **how: [r.video_id for r in catalog.claim_batch(videos, channels, f"file://{tmp_path}/{base}", "w", how.pop("at", now), how.pop("n", 100), **how).collect()]
    plain = ids("a")
    assert ids("a") == [] and len(plain) > 10
    assert ids("a", at="2024-05-01 00:20:00", n=4) == plain[:4]  # expired leases are free again before any reaper runs
    assert set(ids("b", unhydrated=True)) - set(plain) == {r.video_id for r in videos.where("channel_id <> 'c2' and status = 'discovered' and (next_attempt_at is null or next_attempt_at <= '2024-05-01')").collect()}
    assert {v % 3 for v in ids("c", channel="c2")} == {2}  # a disabled channel, if it is named
    rows = {r.video_id: r.published_at for r in videos.collect()}
    order = [(rows[v] is not None, rows[v], v) for v in plain]
    assert order == sorted(order)
    state = videos.withColumns({"status_reason": F.lit(None).cast("string"), "attempts": F.lit(1), "recheck_count": F.lit(0), "needs_audio": F.lit(False), "recheck_after": F.lit(None).cast("timestamp"), "claimed_by": F.lit(None).cast("string"), "lease_expires_at": F.lit(None).cast("timestamp")})
    blocked = spark.createDataFrame([(13, 1, "blocked")], "video_id long, id long, outcome string").select("*", F.lit(now).cast("timestamp").alias("started_at"), *(F.lit(None).cast(t).alias(c) for c, t in {"target": "string", "reason": "string", "needs_audio": "boolean", "recheck": "boolean", "retry_after": "long", "max_attempts": "int"}.items()))
    after = merges.apply_outcomes(state.where("video_id = 13"), blocked)
    assert after.first().status == "retry" and after.first().next_attempt_at is None
    assert catalog.due(after.withColumn("live_broadcast_content", F.lit("none")), now).first().why == "retry"
    assert [r.video_id for r in catalog.claim_batch(after, channels, f"file://{tmp_path}/d", "w", now).collect()] == [13]


def test_commits_of_two_writers(spark, tmp_path):
    base = f"file://{tmp_path}/s"
    assert merges.write_snapshot(spark.range(1), base, "t", after=-1)
    assert not merges.write_snapshot(spark.range(2), base, "t", after=-1) and merges.read_snapshot(spark, base, "t").count() == 1
    add = [threading.Thread(target=merges.commit, args=(spark, base, "t", lambda rows, k=k: rows.unionByName(spark.range(k, k + 1)))) for k in range(10, 16)]
    [a.start() for a in add]
    [a.join() for a in add]
    assert sorted(r.id for r in merges.read_snapshot(spark, base, "t").collect()) == [0, *range(10, 16)] and merges.last_snapshot(spark, base, "t")[0] == 6
    assert len([f for f in (tmp_path / "s" / "t-pointers").iterdir() if f.suffix == ".json"]) == 7 and not [f for f in (tmp_path / "s" / "t-pointers").iterdir() if len(f.name) == 33]


def _files(folder):
    return {str(f.relative_to(folder)): f.stat().st_mtime_ns for f in folder.rglob("*.parquet") if f.is_file()}


def test_a_small_update_leaves_other_parts_alone(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    rows = spark.range(5000).select("id", F.lit("old").alias("title"), F.lit(1).alias("n"))
    merges.write_parts(rows, path, ["id"], 32)
    before = _files(tmp_path / "t")
    updates = spark.createDataFrame([(7, "new"), (8, None), (99_999, "fresh")], "id long, title string")
    hit = merges.merge_parts(path, updates, ["id"], {"title": merges.new_if_known}, 32, defaults={"n": F.lit(0)})
    after = _files(tmp_path / "t")
    parts = lambda files: {f.split("/")[0] for f in files}
    changed = parts(f for f in before if after.get(f) != before[f])
    assert 1 <= hit <= 3 and len(changed) == hit and len(before) == 32 and parts(after) == parts(before)
    got = {r.id: (r.title, r.n) for r in spark.read.parquet(path).collect()}
    assert len(got) == 5001 and got[7] == ("new", 1) and got[8] == ("old", 1) and got[99_999] == ("fresh", 0)
    assert merges.merge_parts(path, updates.limit(0), ["id"], {}, 32) == 0 and _files(tmp_path / "t") == after
    with pytest.raises(Exception, match="(?i)merge"):  # the given catalogue's tables know no MERGE INTO; the plan is made and refused
        rows.write.mode("overwrite").option("path", f"file://{tmp_path}/m").saveAsTable("merged_videos")
        merges.merge_table("merged_videos", updates, ["id"], {"title": merges.new_if_known}, {"n": F.lit(0)})
    spark.sql("DROP TABLE merged_videos")


def test_retention_drops_days(spark, tmp_path):
    path = f"file://{tmp_path}/log"
    log = spark.range(240).select("id", F.col("id").alias("video_id"), (F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(F.lit(0), F.col("id").cast("int"))).alias("started_at"))
    merges.write_attempts(log.union(spark.createDataFrame([(999, 1, None)], log.schema)), path)
    before = _files(tmp_path / "log")
    assert merges.retain_attempts(spark, path, "2024-01-08 12:00:00", 3) == (4, 1)
    after = _files(tmp_path / "log")
    days = lambda files: {f.split("/")[0][4:] for f in files}
    assert days(before) - days(after) == {f"2024-01-0{d}" for d in range(1, 5)}
    assert {f for f in before if after.get(f) == before[f]} == {f for f in before if f.split("/")[0][4:] > "2024-01-05"}
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == [*range(108, 240), 999]
    assert merges.retain_attempts(spark, path, "2024-01-08 12:00:00", 3)[0] == 0


def test_a_cluster_without_a_shared_folder_is_refused():
    session = SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: default), sparkContext=SimpleNamespace(master="local-cluster[2,1,1024]"))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        staging.shared_dir(session)


def test_hydration_report(spark):
    asked = spark.createDataFrame([(b, v) for b in range(3) for v in range(b * 4, b * 4 + 4)], "batch long, video_id long")
    judged = spark.createDataFrame([(0, "metadata_ok", None), (1, "skipped", "too long"), (2, "unavailable", "private"), (4, "metadata_ok", None)], "video_id long, status string, reason string")
    missing = reports.missing_details(asked, judged)
    total, reasons = reports.hydration_report(asked, judged, missing)
    assert tuple(total.first()) == (12, 2, 1, 5, 4)
    assert {(r.reason, r.videos) for r in reasons.collect()} == {("too long", 1), ("private", 1), ("details were not returned", 4), ("deferred: no answer for the batch", 4)}
    nothing = reports.hydration_report(asked.limit(0), judged.limit(0), missing.limit(0))
    assert tuple(nothing[0].first()) == (0, 0, 0, 0, 0) and nothing[1].count() == 0


def test_audit(spark):
    outputs = spark.createDataFrame([(1, 0), (2, 5), (2, 0)], "video_id long, length long")
    assert {(r.video_id, r.state) for r in reports.audit(spark.range(4).select(F.col("id").alias("video_id")), outputs).collect()} == {(0, "no output"), (1, "empty output"), (3, "no output")}


def _bent_titles(rng, n, letters, longest):
    out = set()
    while len(out) < n:
        t = "".join(rng.choice(letters) for _ in range(rng.randint(1, longest)))
        for _ in range(3):
            u = list(t)
            for _ in range(rng.randint(0, max(1, len(t) // 6))):
                at = rng.randrange(len(u) + 1)
                u[at : at + rng.randint(0, 2)] = rng.choice(["", "q", letters[0], "zz"])
            out.add(" ".join("".join(u).split()))
    return sorted(out - {""})


@pytest.mark.parametrize("threshold", [0.3, 0.6, 0.86, 1.0])
def test_runs_of_many_pairs_at_once(threshold):
    import numpy as np

    rng = random.Random(3)
    pairs = [(a, rng.choice([a, b, a[: len(a) // 2] + b])) for t in ("ab", "abcdefghij ") for a, b in zip(*[iter(_bent_titles(rng, 300, t, 90))] * 2)]
    codes = np.array([ord(c) for a, b in pairs for c in a + b], np.uint8)
    n1, n2 = (np.array([len(p[k]) for p in pairs]) for k in (0, 1))
    at = np.cumsum(n1 + n2) - n1 - n2
    want = [SequenceMatcher(None, a, b).ratio() >= threshold for a, b in pairs]
    assert corpus._similar(codes, at, n1, at + n1, n2, threshold).tolist() == want and any(want)


def test_only_similar_titles_are_written(spark, monkeypatch):
    """Titles of common words pass a bound of bigrams without being similar (of 420 titles some hundred pairs did); long ones and ones of many
    letters are compared as well."""
    rng, met = random.Random(5), {}
    words = ["the", "and", "that", "of", "ation", "ther", "hen", "on", "is", "es", "to", "an"]
    titles = {" ".join(rng.choice(words) + rng.choice(["", *words]) for _ in range(8)) for _ in range(400)}
    titles |= {t[:9] + "x" + t[10:] for t in list(titles)[:20]} | {"of " * k + "end" for k in range(60, 100)}
    titles |= set(_bent_titles(rng, 60, "ab cd", 320)) | set(_bent_titles(rng, 30, [chr(0x4E00 + i) for i in range(400)], 40))
    titles = sorted(titles)
    written = corpus.table
    monkeypatch.setattr(corpus, "table", lambda df, name: met.setdefault(name, written(df, name)))
    got = {(r.a, r.b) for r in corpus.similar_titles(spark.createDataFrame([(t, i) for i, t in enumerate(titles)], "title string, rank long"), 0.86, 64).collect()}
    alike = lambda a, b: abs(len(a) - len(b)) <= 0.4 * max(len(a), len(b)) and SequenceMatcher(None, a, b).ratio() >= 0.86
    assert got == {(a, b) for i, a in enumerate(titles) for b in titles[i + 1 :] if alike(a, b)} and any(len(a) > 256 for a, _ in got)
    assert met["title-pairs"].count() == len(got)


def test_a_plan_of_bent_titles_meets_numbers_only(spark, monkeypatch):
    """Every video of a plan is kept or a duplicate of its cluster as the plain ratio says; pairs of titles are written as two numbers."""
    met, written = {}, corpus.table
    monkeypatch.setattr(corpus, "table", lambda df, name: met.setdefault(name, written(df, name)))
    titles = sorted(set(_bent_titles(random.Random(4), 90, "abcdefgh", 24)))
    rows = [(i, t, 100 + i) for i, t in enumerate(titles)]
    got = {r.video_id: r["class"] for r in corpus.prune_plan(spark.createDataFrame(rows, "video_id long, title string, words long"), "", min_words=0).collect()}
    heads = {}
    for i, t in enumerate(titles):
        near = [h for h in heads if abs(len(h) - len(t)) <= 0.4 * max(len(h), len(t)) and SequenceMatcher(None, h, t).ratio() >= 0.86]
        heads.setdefault(near[0] if near else t, []).append(i)
    kept = {max(own) for own in heads.values()}
    assert got == {i: "deep" if i in kept else "duplicate" for i in range(len(titles))} and len(kept) < len(titles)
    assert met["title-edges"].columns == ["x", "y"]


def test_few_windows_are_compared_by_runs(monkeypatch):
    """The best of many windows with common characters, as by the full slide; a ratio is computed for three of them at most."""
    rng, asked = random.Random(11), []

    class Counted(SequenceMatcher):
        def ratio(self):
            asked.append(1)
            return super().ratio()

    monkeypatch.setattr(cards, "SequenceMatcher", Counted)
    parts = ["th", "er", "on", "an", "re", "he", "in", "ed", "ti", "es", "st", "en", "at", "ha"]
    text = " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 4))) for _ in range(400))
    windows = cards.Windows(text)
    for at in range(0, len(text) - 70, 97):
        anchor = f"{text[at : at + 30].strip()} x {text[at + 30 : at + 60].strip()}"
        asked.clear()
        for wide, least in ((1.4, cards.NEAR), (1.6, cards.REPAIR)):
            want = slid(anchor, text, wide)
            assert windows.best(anchor, wide, least) == (want if want[0] >= least else (0.0, None))
            assert windows.best(anchor, wide, least, any_of=True)[0] <= want[0]
        assert len(asked) <= 4 * 3


@pytest.mark.parametrize("least", [0.1, 0.25, 0.6])
def test_a_passage_of_many_bodies_is_met_once(spark, monkeypatch, least):
    """Bodies and clips share two common passages, in whole or in part, and some clips are pieces of a body; the best is that of all pairs."""
    met, written = {}, corpus.table
    monkeypatch.setattr(corpus, "table", lambda df, name: met.setdefault(name, written(df, name)))
    rng, passages = random.Random(14), [[f"{p}{i}" for i in range(20)] for p in "pq"]
    own = lambda n: [f"w{rng.randrange(9)}" if rng.random() < 0.3 else f"u{rng.randrange(10**9)}" for _ in range(n)]
    longer = [own(rng.randint(20, 40)) + passages[rng.random() < 0.3][rng.choice((0, 0, 0, 8)) :] + own(rng.randint(20, 60)) for _ in range(90)]
    clips = [own(rng.randint(0, 15)) + rng.choice(passages)[rng.choice((0, 0, 3)) : rng.choice((16, 20))] + own(rng.randint(0, 12)) for _ in range(60)]
    clips += [w[at : at + rng.randint(14, 45)] for w in rng.sample(longer, 30) for at in (rng.randrange(len(w) - 14),)]
    rows = [(i, " ".join(w)) for i, w in enumerate(longer + clips)]
    grams = {i: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for i, t in rows}
    want = {}
    for i, t in rows:
        if len(t.split()) <= 50 and len(grams[i]) >= 10:
            best = min((-len(grams[i] & grams[j]), -len(u.split()), j) for j, u in rows if len(u.split()) > 50)
            if best[0] and -best[0] >= least * len(grams[i]):
                want[i] = (best[2], round(-best[0] / len(grams[i]), 3))
    got = {r.clip: (r.source, r.containment) for r in corpus.contained_clips(spark.createDataFrame(rows, "video_id long, body string"), short_words=50, least=least).collect()}
    assert got == want and len(want) > 40
    assert sum(df.count() for name, df in met.items() if name in ("clip-pairs", "clip-more-pairs")) < 6 * len(clips)


def test_shingles_of_one_side_are_not_moved(spark):
    """Codes of four bytes and the bit map keep all shingles that both sides have, and hardly any other."""
    spread = lambda k: k * 0x9E3779B97F4A7C15 % 2**64 - 2**63
    rows = [(i, 10 if i < 40 else 900, [spread(i % 40 * 1000 + k + (i >= 40) * 100) for k in range(300)]) for i in range(80)]
    sets = spark.createDataFrame(rows, "video_id long, words int, g array<long>")
    each = sets.select("video_id", "words", F.explode("g").alias("shingle"))
    both = each.where("words = 10").select("shingle").intersect(each.where("words = 900").select("shingle"))
    codes = corpus.shared_codes(sets, 500)
    kept = corpus.sieved(each, codes)
    want = each.join(both, "shingle", "left_semi")
    assert want.count() > 5000 and want.select(kept.columns).exceptAll(kept).isEmpty() and kept.count() < 1.05 * want.count() < each.count()
    assert corpus.shared_codes(sets.limit(0), 500).count() == 0 == corpus.shared_codes(sets.where("words = 10"), 500).count()
