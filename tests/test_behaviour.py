"""Metric semantics on hand-written rows, and against brute force on random ones."""

import random
from collections import defaultdict

import pytest

from eventloom.functions.timeparts import to_ms
from eventloom.operators import behaviour as b
from eventloom.operators.funnel import funnel_stats

SCHEMA = "userId string, event string, page string, timestamp bigint, seq bigint"
MIN = 60_000


@pytest.fixture()
def events(spark):
    def make(*given):
        full = [(u, e, "/home", t, i) for i, (u, e, t) in enumerate(given)]
        return b.with_event_time(spark.createDataFrame(full, SCHEMA))
    return make


def random_events(seed, users=6, n=400, span=40 * MIN, grain=1):
    """A third of the rows belong to one user; coarse grains give many equal times."""
    rng = random.Random(seed)
    kinds = ["view", "click", "purchase", "signup"]
    out = []
    for seq in range(n):
        user = "hot" if rng.random() < 1 / 3 else f"u{rng.randrange(users)}"
        out.append((user, rng.choice(kinds), "/p", rng.randrange(span) // grain * grain, seq))
    rng.shuffle(out)
    return out


def test_interval_lengths():
    assert [to_ms(i) for i in ("1 minute", "5 minutes", "10 seconds", "7 days")] == [
        MIN, 5 * MIN, 10_000, 7 * 86_400_000]


def test_event_on_a_boundary_belongs_to_the_later_window(events, rows):
    got = rows(b.events_per_type(events(("u", "view", MIN - 1), ("u", "view", MIN))))
    assert got == [("events_per_type", "view", 0, MIN, 1.0),
                   ("events_per_type", "view", MIN, 2 * MIN, 1.0)]


def test_page_views_count_every_event_type(events, rows):
    got = rows(b.page_views(events(("u", "view", 1), ("u", "signup", 2), ("v", "click", 3))))
    assert got == [("page_views", "/home", 0, MIN, 3.0)]


def test_unique_users(events, rows):
    data = events(("u", "view", 1), ("u", "view", 2), ("v", "click", 3))
    want = [("unique_users_per_page", "/home", 0, MIN, 2.0)]
    assert rows(b.unique_users_per_page(data)) == want
    assert rows(b.unique_users_per_page(data, approx=True)) == want


def test_conversion_ignores_order_and_counts_every_active_user(events, rows):
    data = events(("a", "purchase", 1), ("a", "view", 2), ("b", "signup", 3))
    got = rows(b.conversion_rate(data))
    assert got == [("conversion_rate", "global", i * MIN, (i + 1) * MIN, 0.5) for i in range(5)]


def test_conversion_needs_both_in_one_window(events, rows):
    got = rows(b.conversion_rate(events(("a", "view", 0), ("a", "purchase", 4 * MIN))))
    assert [(r[2] // MIN, r[4]) for r in got] == [(i, float(i == 4)) for i in range(9)]


@pytest.mark.parametrize("size,slide", [("5 minutes", "1 minute"), ("4 minutes", "4 minutes"),
                                        ("30 minutes", "10 minutes")])
@pytest.mark.parametrize("seed", [1, 2])
def test_conversion_against_brute_force(spark, rows, seed, size, slide):
    given = random_events(seed, n=120)
    width, step = to_ms(size), to_ms(slide)
    seen = defaultdict(set)
    for user, kind, _, t, _ in given:
        start = t // step * step
        while start > t - width:
            seen[start, user].add(kind)
            start -= step
    windows = defaultdict(list)
    for (start, _), kinds in seen.items():
        windows[start].append({"view", "purchase"} <= kinds)
    want = sorted(("conversion_rate", "global", s + width - step, s + width, sum(c) / len(c))
                  for s, c in windows.items())
    data = b.with_event_time(spark.createDataFrame(given, SCHEMA))
    assert rows(b.conversion_rate(data, size, slide)) == want


def test_session_gap_is_inclusive(events, rows):
    gap = 30 * MIN
    assert rows(b.session_stats(events(("u", "view", 5), ("u", "view", 5 + gap)))) == [
        ("u", 5, 5 + gap, gap, 2)]
    assert rows(b.session_stats(events(("u", "view", 5), ("u", "view", 6 + gap)))) == [
        ("u", 5, 5, 0, 1), ("u", 6 + gap, 6 + gap, 0, 1)]


@pytest.mark.parametrize("seed", [3, 4])
def test_sessions_against_brute_force(spark, rows, seed):
    given = random_events(seed, span=600 * MIN)
    by_user = defaultdict(list)
    for user, _, _, t, _ in given:
        by_user[user].append(t)
    want = []
    for user, times in by_user.items():
        run = []
        for t in sorted(times):
            if run and t - run[-1] > 7 * MIN:
                want.append((user, run[0], run[-1], run[-1] - run[0], len(run)))
                run = []
            run.append(t)
        want.append((user, run[0], run[-1], run[-1] - run[0], len(run)))
    data = b.with_event_time(spark.createDataFrame(given, SCHEMA))
    assert rows(b.session_stats(data, "7 minutes")) == sorted(want)


def test_funnel_presence_is_unordered_and_completion_ordered(events, rows):
    got = rows(funnel_stats(events(("u", "purchase", 1), ("u", "click", 2), ("u", "view", 3))))
    assert got == [(0, 5 * MIN, 1, 1, 1, 0, 0, 0)]
    got = rows(funnel_stats(events(("u", "view", 1), ("u", "click", 2), ("u", "purchase", 3))))
    assert got == [(0, 5 * MIN, 1, 1, 1, 1, 1, 1)]


@pytest.mark.parametrize("order,done", [
    (("view", "click", "purchase"), (1, 1, 1)), (("click", "view", "purchase"), (0, 0, 0)),
    (("view", "purchase", "click"), (1, 0, 0)), (("purchase", "click", "view"), (0, 0, 0)),
])
def test_funnel_ties_keep_arrival_order(events, rows, order, done):
    got = rows(funnel_stats(events(*[("u", e, 7) for e in order])))
    assert got == [(0, 5 * MIN, 1, 1, 1, *done)]


def test_funnel_click_hidden_between_outer_clicks(events, rows):
    """First and last click do not settle it; the click between view and purchase does."""
    path = ["click", "view", "click", "purchase", "click"]
    got = rows(funnel_stats(events(*[("u", e, i) for i, e in enumerate(path)])))
    assert got == [(0, 5 * MIN, 1, 1, 1, 1, 1, 1)]
    path = ["click", "view", "purchase", "click"]
    got = rows(funnel_stats(events(*[("u", e, i) for i, e in enumerate(path)])))
    assert got == [(0, 5 * MIN, 1, 1, 1, 1, 0, 0)]


def test_funnel_window_without_steps_is_kept(events, rows):
    assert rows(funnel_stats(events(("u", "signup", 1)))) == [(0, 5 * MIN, 0, 0, 0, 0, 0, 0)]


def brute_funnel(given, width):
    groups = defaultdict(list)
    for user, kind, _, t, seq in given:
        groups[t // width * width, user].append((t, seq, kind))
    totals = defaultdict(lambda: [0] * 6)
    for (start, _), path in groups.items():
        view = click = purchase = False
        for _, _, kind in sorted(path):
            view = view or kind == "view"
            click = click or (kind == "click" and view)
            purchase = purchase or (kind == "purchase" and click)
        kinds = {kind for _, _, kind in path}
        flags = ["view" in kinds, "click" in kinds, "purchase" in kinds, click, purchase, purchase]
        totals[start] = [a + int(f) for a, f in zip(totals[start], flags)]
    return sorted((s, s + width, *counts) for s, counts in totals.items())


@pytest.mark.parametrize("seed", [5, 6, 7])
@pytest.mark.parametrize("grain", [1, 60_000])
def test_funnel_against_brute_force(spark, rows, seed, grain):
    given = random_events(seed, users=40, n=500, grain=grain)
    data = b.with_event_time(spark.createDataFrame(given, SCHEMA))
    got = rows(funnel_stats(data))
    assert got == brute_funnel(given, 5 * MIN)
    for _, _, viewed, _, _, vc, cp, vcp in got:
        assert cp == vcp <= vc <= viewed


def test_heatmap_hour_is_utc(events, rows):
    got = rows(b.activity_heatmap(events(("u", "view", 25 * 3_600_000))))
    assert got[0][1] == "1"


def test_retention_looks_inside_the_hour_only(events, rows):
    hour = 3_600_000
    data = events(("a", "view", 1), ("a", "view", 2), ("b", "view", 3), ("b", "view", hour))
    assert rows(b.retention(data)) == [(0, hour, 1, 1, 2), (hour, 2 * hour, 0, 1, 1)]


def test_totals_agree_across_metrics(spark):
    given = random_events(8)
    data = b.with_event_time(spark.createDataFrame(given, SCHEMA))
    total = lambda df, c: sum(r[c] for r in df.collect())
    assert total(b.events_per_type(data), "value") == len(given)
    assert total(b.page_views(data), "value") == len(given)
    assert total(b.activity_heatmap(data), "value") == len(given)
    assert total(b.session_stats(data), "events") == len(given)
    assert total(b.count_metrics(data), "value") == 3 * len(given)
    for r in b.retention(data).collect():
        assert r.returningUsers + r.newUsers == r.totalUsers


def test_slide_must_divide_size(events):
    with pytest.raises(ValueError):
        b.conversion_rate(events(("u", "view", 1)), "5 minutes", "2 minutes")
