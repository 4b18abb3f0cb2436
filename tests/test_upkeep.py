"""Score directions, page numbers and history folders against plain Python."""

import json
import random

from foliolake.operators import ocr, pages, upkeep


def test_directions_carry_on_what_is_just_above(spark):
    rows = [  # n, x0, y0, x1, y1
        (0, 0.0, 0.0, 100.0, 10.0), (1, 200.0, 0.0, 300.0, 10.0), (2, 10.0, 12.0, 90.0, 22.0), (3, 210.0, 14.0, 280.0, 24.0), (4, 10.0, 60.0, 90.0, 70.0), (5, 0.0, 24.0, 50.0, 34.0), (6, 40.0, 60.0, 60.0, 70.0),
    ]
    lines = spark.createDataFrame([(1, 1, n, 0, 0, *box) for n, *box in rows] + [(1, 2, 0, 0, 0, 0.0, 0.0, 1.0, 1.0)], "doc_id int, page_no int, n int, block int, par int, x0 double, y0 double, x1 double, y1 double")
    got = {(r["page_no"], r["n"]): r["first"] for r in ocr.direction_groups(lines).collect()}
    assert got == {(1, 0): 0, (1, 1): 1, (1, 2): 0, (1, 3): 1, (1, 4): 4, (1, 5): 0, (1, 6): 6, (2, 0): 0}


def test_pages_take_lines_while_they_fit(spark):
    rng = random.Random(1)
    rows = [(d, n, float(rng.choice([8, 12, 18, 40, 500]))) for d in range(5) for n in range(60)]
    want, used, page = {}, 0.0, 0
    for d, n, h in rows:
        if n == 0:
            used, page = 0.0, 0
        elif used + h > 100:
            used, page = 0.0, page + 1
        used += h
        want[d, n] = page
    got = pages.paginated(spark.createDataFrame(rows, "d int, n int, height double"), 100, "d").collect()
    assert {(r["d"], r["n"]): r["page"] for r in got} == want


def test_history_folder(spark, tmp_path):
    def put(name, text):
        (tmp_path / name).write_text(text)

    put("a.json", json.dumps({"id": "a", "created_at": "2024-01-01", "source_extension": "docx", "original_name": "x"}))
    put("a.md", "12345")
    put("a.source.docx", "z")
    put("b.json", json.dumps({"id": "b", "created_at": "2024-02-01"}))
    put("c.json", "{no")
    put("d.json", json.dumps({"created_at": "2024-03-01"}))
    got = [(r["id"], r["size_bytes"], r["has_source"]) for r in upkeep.history_folder(spark, str(tmp_path)).collect()]
    assert got == [("b", 0, False), ("a", 5, True)]


def test_snapshots_hold_no_results(spark, tmp_path):
    jobs = spark.createDataFrame([(1, "queued", "x"), (2, "complete", "y")], "job_id int, status string, result string")
    for _ in range(2):
        upkeep.keep_snapshots(jobs, f"{tmp_path}/jobs")
    back = spark.read.json(f"{tmp_path}/jobs")
    assert sorted(back.columns) == ["job_id", "status"] and back.count() == 4
