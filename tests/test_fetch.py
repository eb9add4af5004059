"""Paced fetching: the pace by a simulated clock, and the ledger after failures."""

import os
import time
from collections import Counter, defaultdict

import pytest

from tesserae.operators import fetch

SLOW = ["slow.org", "slower.org", "quiet.org"]
URLS = [f"http://{SLOW[i % 2]}/{i}" for i in range(12)] + [f"http://fast{i % 3}.org/{i}" for i in range(150)] + ["http://slow.org/0", None, ""]


class Logged:
    """Notes each request in a file; fails hard at the urls of ``bad`` while the file ``armed`` is there."""

    def __init__(self, folder, bad=()):
        self.log, self.armed, self.bad = f"{folder}/log", f"{folder}/armed", bad

    def __call__(self, url):
        if url in self.bad and os.path.exists(self.armed):
            os._exit(3)
        with open(self.log, "a") as f:
            f.write(url + "\n")
        return 200, url.encode(), None

    def requests(self):
        return Counter(open(self.log).read().split("\n")[:-1])


def planned(spark, rate=1.0):
    return fetch.plan(spark.createDataFrame(list(enumerate(URLS)), "id long, u string"), "u", "id", SLOW, rate)


@pytest.mark.parametrize("rate", [1.0, 4.0])
def test_one_request_a_host_and_interval(spark, tmp_path, rate):
    get = Logged(tmp_path)
    got = fetch.fetch(planned(spark, rate), get, "u", "id", 3, f"file://{tmp_path}/ledger", fetch.Simulated(), rate).collect()
    assert len(got) == len(URLS) and get.requests() == Counter({u for u in URLS if u})
    at = defaultdict(set)
    for r in got:
        url = URLS[r["id"]]
        if not url:
            assert (r["image_status"], r["n_bytes"], r["content"], r["fetched_at"]) == ("no_url", 0, None, None)
            continue
        assert (r["image_status"], bytes(r["content"])) == ("ok", url.encode())
        if "slow" in url:
            at[url.split("/")[2]].add(r["fetched_at"])
    assert {h: sorted(x) for h, x in at.items()} == {h: [i / rate for i in range(6)] for h in SLOW[:2]}


def test_a_call_after_a_crash_fetches_the_rest(spark, tmp_path):
    get = Logged(tmp_path, ["http://slow.org/6", "http://fast0.org/141"])
    open(get.armed, "w").close()
    arguments = (planned(spark), get, "u", "id", 3, f"file://{tmp_path}/ledger", fetch.Simulated())
    with pytest.raises(Exception, match="crashed"):
        fetch.fetch(*arguments)
    before = get.requests()
    assert 3 <= before.total() < 160 and not before["http://slow.org/6"]
    kept = fetch.ledger_table(spark, arguments[5]).count()
    assert kept >= 3
    os.remove(get.armed)
    got = fetch.fetch(*arguments).collect()
    assert len(got) == len(URLS) and sum(r["image_status"] == "ok" for r in got) == len(URLS) - 2
    slow = {u: n for u, n in get.requests().items() if "slow" in u}
    assert set(slow.values()) == {1} and len(slow) == 12  # nothing that had a place in the schedule is fetched again
    assert get.requests().total() <= 162 + 3 * fetch.TOGETHER  # of others, what stood in one unwritten file of each task
    again = get.requests()
    assert sorted(map(str, fetch.fetch(*arguments).collect())) == sorted(map(str, got)) and get.requests() == again


def test_a_task_that_is_killed_skips_what_it_had(tmp_path):
    """The second attempt goes on where the first one ended, and keeps its distance to the first one's last request."""
    get, rows = Logged(tmp_path), [("slow.org", f"http://slow.org/{i}", float(i), True) for i in range(6)]

    def killed():
        yield from rows[:4]
        raise KeyboardInterrupt

    clock, folder = fetch.Simulated(), f"file://{tmp_path}/ledger"
    with pytest.raises(KeyboardInterrupt):
        fetch.paced(killed(), get, fetch.Ledger(folder), clock, 0.0, 1.0)
    open(f"{tmp_path}/ledger/half.tmp", "w").close()  # what a killed write leaves
    late = fetch.Simulated()
    late.at = 3.25
    assert fetch.paced(iter(rows), get, fetch.Ledger(folder), late, 0.0, 1.0) == 2
    assert set(get.requests().values()) == {1} and len(get.requests()) == 6
    found = fetch.Ledger(folder).finished()
    assert sorted(zip(found["fetched_at"].to_pylist(), found["url"].to_pylist())) == [(float(i), r[1]) for i, r in enumerate(rows)]


def test_a_late_task_keeps_the_pace(tmp_path):
    """A task that begins late doesn't send at once all that is overdue."""
    clock = fetch.Simulated()
    clock.at = 100.0
    rows = [(h, f"http://{h}/{i}", float(i), True) for i in range(4) for h in ("a", "b")]
    fetch.paced(iter(rows), lambda u: (429, None, None), fetch.Ledger(f"file://{tmp_path}/l"), clock, 0.0, 2.0)
    found = fetch.Ledger(f"file://{tmp_path}/l").finished()
    for host in "ab":
        own = sorted(t for t, h in zip(found["fetched_at"].to_pylist(), found["host"].to_pylist()) if h == host)
        assert own == [100.0, 100.5, 101.0, 101.5]


def test_wall_time(spark, tmp_path):
    rows = fetch.plan(spark.createDataFrame([(i, f"http://slow.org/{i}") for i in range(3)], "id long, u string"), "u", "id", SLOW, 5.0)
    at = sorted(r["fetched_at"] for r in fetch.fetch(rows, Logged(tmp_path), "u", "id", 2, rate=5.0).collect())
    assert all(b - a >= 0.199 for a, b in zip(at, at[1:]))


def test_a_ledger_of_many_requests_has_few_files(tmp_path, monkeypatch):
    """One file a request would be 5,000 files, which a later reader has to open one by one."""
    rows = [("slow.org", f"http://slow.org/{i}", float(i), True) for i in range(5000)]
    folder = f"{tmp_path}/l"
    assert fetch.paced(iter(rows), lambda u: (200, u.encode(), None), fetch.Ledger(f"file://{folder}"), fetch.Simulated(), 0.0, 1.0) == 5000
    assert len(os.listdir(folder)) <= 3 * fetch.TOGETHER
    found = fetch.Ledger(f"file://{folder}").finished()
    assert sorted(zip(found["fetched_at"].to_pylist(), found["url"].to_pylist())) == [(float(i), r[1]) for i, r in enumerate(rows)]
    monkeypatch.setattr(fetch, "MERGED", 1000)  # files that are large stay as they are
    fetch.paced(iter(rows[:200]), lambda u: (200, b"x" * 500, None), fetch.Ledger(f"file://{folder}2"), fetch.Simulated(), 0.0, 1.0)
    assert len(os.listdir(f"{folder}2")) == 200 and fetch.Ledger(f"file://{folder}2").finished().num_rows == 200


def test_the_query_does_not_wait(spark, tmp_path):
    """60 urls of one throttled host, of which every second page lacks its image: half a minute by wall time."""
    from tesserae.plans import catalog, fixtures

    rows = [(i, f"http://{fixtures.THROTTLED_HOSTS[0]}/{i}") for i in range(60)]
    spark.createDataFrame(rows, "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    began = time.time()
    got = {r["page_id"]: r["image"] for r in catalog.QUERIES["fill_missing"](spark, str(tmp_path)).collect()}
    assert got == {i: "kept" if i % 2 == 0 else u for i, u in rows} and time.time() - began < 25
