"""The settled stream's state by buckets against the plain count of a chapter at a time."""

import random

import pandas as pd
import pytest

from foliospark.streaming import settled as S


class Store:
    """A value or list state, with the number of calls."""

    def __init__(self):
        self.rows, self.calls = [], 0

    def exists(self):
        return bool(self.rows)

    def get(self):
        self.calls += 1
        return self.rows[0] if self.single else iter(self.rows)

    def put(self, rows):
        self.calls, self.rows = self.calls + 1, list(rows)

    def update(self, row):
        self.put([row])

    def appendValue(self, row):  # noqa: N802
        self.calls, self.rows = self.calls + 1, [*self.rows, row]

    def getValueState(self, name, schema):  # noqa: N802
        self.value = Store()
        self.value.single = True
        return self.value

    def getListState(self, name, schema):  # noqa: N802
        self.list = Store()
        self.list.single = False
        return self.list


def plainly(batches):
    """For each batch the set of (task, chapter, pages, failed, status), a row at a time."""
    pages, reported = {}, set()
    for rows in batches:
        totals = {}
        for task, chapter, page, total, ended in rows:
            totals[task, chapter] = max(total, totals.get((task, chapter), 0))
            if ended != S.OPEN and (task, chapter) not in reported:
                pages.setdefault((task, chapter), {}).setdefault(page, ended)
        out = set()
        for at, total in totals.items():
            seen = pages.get(at, {})
            if at not in reported and total and len(seen) >= total:
                failed = sum(e == S.FAILED for e in seen.values())
                out.add((*at, len(seen), failed, "failed" if failed else "done"))
                reported.add(at)
        yield out


@pytest.mark.parametrize("seed", range(6))
def test_buckets_count_as_chapters_do(seed, monkeypatch):
    monkeypatch.setattr(S, "LISTS", 2)
    r = random.Random(seed)
    handle, states = Store(), S.SettledChapters()
    states.init(handle)
    big = 2**53
    batches = [[(r.randrange(-3, 9) + big * r.randrange(2), r.randrange(3), r.randrange(5), r.randrange(5), r.randrange(3)) for _ in range(r.choice((1, 40, 150)))] for _ in range(12)]
    for rows, want in zip(batches, plainly(batches), strict=True):
        pdf = pd.DataFrame(rows, columns=["task_id", "chapter", "page", "total", "ended"])
        got = [tuple(x) for out in states.handleInputRows((0, False, False), iter([pdf[:7], pdf[7:]]), None) for x in out.itertuples(index=False)]
        assert len(got) == len(set(got)) and set(got) == want
    assert len(handle.list.rows) <= 3


def test_calls_do_not_grow_with_chapters():
    handle, states = Store(), S.SettledChapters()
    states.init(handle)
    pdf = pd.DataFrame({"task_id": range(5000), "chapter": 1, "page": 1, "total": 1, "ended": S.DONE})
    out = list(states.handleInputRows((0, False, True), iter([pdf]), None))
    assert [len(x) for x in out] == [5000] and out[0].chapter.isna().all()
    assert handle.value.calls + handle.list.calls <= 4
