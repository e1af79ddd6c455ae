"""Requests of hosts and pages of listings against sequential models."""

import random

import pytest

from terncove.operators import pace
from terncove.sources import listings


def followed(requests, pause, backoff, most):
    """One after another, as a crawler would."""
    free, streak, out = {}, {}, {}
    for host, seq, ready, failed in sorted(requests):
        start = max(ready, free.get(host, float("-inf")))
        streak[host] = streak.get(host, 0) + 1 if failed else 0
        rest = backoff * 2 ** min(streak[host] - 1, most) if streak[host] else 0
        free[host] = start + pause + rest
        out[host, seq] = (start, streak[host])
    return out


@pytest.mark.parametrize("block", [3, 17, 10_000])
def test_start_times(spark, block):
    r = random.Random(8)
    requests = [("hot" if k % 2 else f"h{r.randint(0, 5)}", 5 * k + r.randint(0, 4), r.choice([0.0, r.uniform(0, 900)]), r.random() < 0.4) for k in range(400)]
    df = spark.createDataFrame(requests, "host string, seq long, ready double, failed boolean")
    want = followed(requests, 1.5, 2.0, 3)
    got = {(x.host, x.seq): x.start for x in pace.start_times(df, 1.5, 2.0, 3, block).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k][0]) for k in want)
    assert {(x.host, x.seq): x.streak for x in pace.failure_streaks(df, block).collect()} == {k: v[1] for k, v in want.items()}
    assert pace.start_times(df.where("seq < 0"), 1.0).count() == 0


def crawled(landed, sections, most):
    out = []
    for city in sorted({c for c, *_ in landed}):
        seen = []
        for section in sections:
            for page in range(1, most + 1):
                hit = next((x for x in landed if x[:3] == (city, section, page)), None)
                if hit is None or hit[3] is False or hit[4] is None:
                    break
                found = list(dict.fromkeys(p for p in hit[5] if p not in seen))
                if not found:
                    break
                seen += found
                out += [(city, section, page, p) for p in found]
    return sorted(out)


def test_listing_crawl_stops(spark):
    r = random.Random(9)
    landed = []
    for city in "abcdef":
        for section in ("one", "two"):
            for page in range(1, 12):
                cards = [f"/clinic/c{r.randint(0, 40)}" for _ in range(r.randint(0, 4))]
                html = None if r.random() < 0.04 else "".join(f'<a href="{r.choice(["", "https://likarni.com"])}{c}">' for c in cards)
                if r.random() > 0.04:
                    landed.append((city, section, page, r.choice([True, True, True, None, r.random() < 0.5]), html, cards))
    df = spark.createDataFrame([x[:5] for x in landed], "city string, section string, page int, allowed boolean, html string")
    got = sorted((x.city, x.section, x.page, x.path) for x in listings.listing_crawl(df, ["one", "two"], 9).collect())
    assert got == crawled(landed, ["one", "two"], 9) and {x[1] for x in got} == {"one", "two"}
