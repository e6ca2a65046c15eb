"""Queries whose input once lost rows on the way."""

import hashlib
from collections import Counter
from datetime import datetime, timedelta


from momentquery import registry
from momentquery.operators import identity
from momentquery.sources import testdata as td


def test_every_customer_is_a_clip(spark, tmp_path):
    n, place = 3200, str(tmp_path)
    customers = spark.range(n).selectExpr("id as c_custkey", "concat('c', id) as c_name", "'m' as c_mktsegment")
    customers.write.parquet(f"{place}/customer.parquet")
    clips = td.clips(spark, place).collect()
    assert {r.title for r in clips} == {f"c{i}" for i in range(n)}
    assert len({(r.job_id, r.clip_id) for r in clips}) == len(clips) == n
    jobs = Counter(r.job_id for r in clips)
    assert max(jobs.values()) == 15 and len(jobs) == 300
    best = {job: sorted((-r.score, r.clip_id) for r in clips if r.job_id == job)[:3] for job in jobs}
    got = registry.QUERIES["approvals"](spark, place).collect()
    assert len(got) == n
    assert {(r.job_id, r.clip_id) for r in got if r.approved} == {(job, clip) for job, top in best.items() for _, clip in top}


def test_sessions_at_the_end_of_the_stream_are_closed(spark, tmp_path):
    at = lambda minutes: datetime(2024, 1, 1) + timedelta(minutes=minutes)
    rows = [(1, at(0)), (1, at(20)), (2, at(25)), (1, at(100)), (2, at(110)), (2, at(125)), (None, at(125))]
    spark.createDataFrame(rows, "user_id long, ts timestamp_ntz").write.parquet(f"{tmp_path}/events.parquet")
    got = {(r.user_id, r.start, r.end, r.n) for r in registry.QUERIES["merged_sessions"](spark, str(tmp_path)).collect()}
    assert got == {(1, at(0), at(20), 2), (2, at(25), at(25), 1), (1, at(100), at(100), 1), (2, at(110), at(125), 2), (None, at(125), at(125), 1)}


def excerpt(lines, most=30000, head=18000, tail=10000):
    whole = "\n".join(lines)
    if len(whole) <= most:
        return whole
    last, budget = len(lines) - 1, most - head - tail
    places = [i for i in dict.fromkeys(int(last * k / 6 + 0.5) for k in range(1, 6)) if 0 < i < last]  # half up
    per = max(budget // len(places), 1)
    middle = "\n".join(x if len(x) <= per else x[: max(per - 1, 1)].rstrip() + "…" for x in (lines[i] for i in places))[:budget].rstrip()
    note = f"\n\n[transcript truncated for brief — kept first {head} chars, 5 representative middle sample(s), and last {tail} chars]\n\n"
    return whole[:head].rstrip() + note + f"[representative middle excerpts]\n{middle}\n" + "\n\n[ending excerpt]\n\n" + whole[-tail:].lstrip()


def test_transcripts_are_cut_beyond_the_operators_limit_only(spark, tmp_path):
    turns = [(conv, turn, "user", f"word{turn % 10} " * n) for conv, many, n in ((0, 3, 10), (1, 8, 80), (2, 62, 40), (3, 98, 120)) for turn in range(many)]
    spark.createDataFrame([(c, t, r, x[: len(x) // 4 * 4]) for c, t, r, x in turns], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    lines = {}
    for r in td.segments(spark, str(tmp_path)).orderBy("job_id", "seg_idx").collect():
        lines.setdefault(r.job_id, []).append(f"[{r.speaker or 'SPEAKER'} {r.start_seconds:.1f}s] {r.text.strip()}")
    sizes = {job: len("\n".join(x)) for job, x in lines.items()}
    assert sizes["job-0"] < 1200 < sizes["job-1"] < 30000 and 1200 < sizes["job-2"] < 30000 < sizes["job-3"]
    want = {(job, sizes[job] > 30000, len(e := excerpt(x)), hashlib.md5(e.encode()).hexdigest()) for job, x in lines.items()}
    assert {tuple(r) for r in registry.QUERIES["brief_excerpts"](spark, str(tmp_path)).collect()} == want
    small = {(job, sizes[job] > 1200, len(e := excerpt(x, 1200, 500, 300)), hashlib.md5(e.encode()).hexdigest()) for job, x in lines.items()}
    cut = identity.excerpts(td.segments(spark, str(tmp_path)), most=1200, head=500, tail=300)
    assert {(r.job_id, r.truncated, len(r.excerpt), hashlib.md5(r.excerpt.encode()).hexdigest()) for r in cut.collect()} == small
