"""Reachability from every source, by brute force over a small table of events."""

from datetime import datetime, timedelta

import pytest

from factloom import bindings

from .test_fixpoint import fifo


@pytest.fixture(scope="module")
def events(spark, tmp_path_factory):
    # two groups of users that share no event type, so that what one source reaches says nothing of the other's
    rows = [(k, u, t) for k, (u, t) in enumerate([(1, "click"), (2, "click"), (3, "click"), (1, "view"), (3, "view"), (2, "plain"), (1, "plain"), (7, "other"), (8, "other"), (9, "other"), (7, "purchase"), (9, "purchase")])]
    folder = str(tmp_path_factory.mktemp("events"))
    spark.createDataFrame([(k, datetime(2024, 1, 1) + timedelta(minutes=k), u, t) for k, u, t in rows], "event_id long, ts timestamp, user_id long, event_type string").write.parquet(f"{folder}/events.parquet")
    steps = [(a[1], b[1], {"click": "proj", "view": "inject"}.get(t, "plain"), a[1] % 3, t == "purchase", a[0]) for t in sorted({t for _, _, t in rows}) for a, b in zip([r for r in rows if r[2] == t], [r for r in rows if r[2] == t][1:])]
    return folder, steps, sorted({u for _, u, _ in rows})


def test_every_user_is_a_source(spark, events):
    folder, steps, users = events
    assert len(users) > 3
    want = {(s, v) for s in users for _, v, _ in fifo([(a, b, "plain", 0, False, 0) for a, b, *_ in steps], [(s, s, 0)])}
    assert sorted(map(tuple, bindings.QUERIES["reach"](spark, folder).collect())) == sorted(want)


def test_field_paths_of_every_user(spark, events):
    folder, steps, users = events
    want = {(s, v, ".".join(map(str, p))) for s, v, p in fifo(steps, [(u, u, 0) for u in users])}
    assert sorted(map(tuple, bindings.QUERIES["reach_k2"](spark, folder).collect())) == sorted(want)
