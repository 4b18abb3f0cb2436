from foliolake.streaming.jobs import step


def walk(*events):
    status, cancel = "", False
    for e in events:
        status, cancel = step(status, cancel, e)
    return status


def test_moves():
    assert walk("enqueue", "start", "finish") == "complete"
    assert walk("enqueue", "cancel", "start") == "cancelled"
    assert walk("enqueue", "start", "cancel", "finish") == "cancelled"
    assert walk("enqueue", "start", "pause", "resume") == "queued"
    assert walk("enqueue", "finish") == "queued"


def test_states_of_all_jobs(spark):
    """The stream's states against each job's events walked in order."""
    from foliolake.plans import service_queries

    sf = "/root/testdata/sf0.001"
    kinds, jobs = ("enqueue", "start", "pause", "resume", "cancel", "finish", "fail"), {}
    for r in spark.read.parquet(f"{sf}/events.parquet").select("user_id", "ts", "event_id").collect():
        jobs.setdefault(r["user_id"], []).append((r["ts"], r["event_id"]))
    want = {j: (walk(*(kinds[n % 7] for _, n in sorted(events))), len(events)) for j, events in jobs.items()}
    assert {r["job_id"]: (r["status"], r["events"]) for r in service_queries.job_states(spark, sf).collect()} == want
