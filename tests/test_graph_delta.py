"""Resolution kept up by what changed equals resolution from nothing."""

from __future__ import annotations

import random

from lorespark.operators import graph

ENTITY = "id string, name string, qualified_name string, file_id long, start_line long"
REFERENCE = "file_id long, reference_text string"


def rows(rng):
    names = [f"n{i}" for i in range(12)]
    e = {}
    for f in range(8):
        for _ in range(5):
            n = rng.choice(names)
            q = f"m{f % 3}.{n}"
            e[f"{f}:{q}:{rng.randrange(3)}"] = (n, q, f)
    entities = [(i, n, q, f, len(i) % 5) for i, (n, q, f) in e.items()]
    refs = {(f, rng.choice([rng.choice(names), f"m{rng.randrange(4)}.{rng.choice(names)}", f"x.y.{rng.choice(names)}", "nothing"])) for f in range(8) for _ in range(10)}
    return entities, refs


def test_delta_equals_full_resolution(spark):
    for seed in range(3):
        rng = random.Random(seed)
        entities, refs = rows(rng)
        later = [r for r in entities if rng.random() > 0.15] + [(f"new{i}", f"n{rng.randrange(14)}", f"m{i}.n{i}", 20 + i, 1) for i in range(3)]
        if seed == 2:
            later = entities
        now = {r for r in refs if rng.random() > 0.1} | {(30, "n1"), (30, "m9.n2")}
        before, after = spark.createDataFrame(entities, ENTITY), spark.createDataFrame(later, ENTITY)
        old, new = spark.createDataFrame(sorted(refs), REFERENCE), spark.createDataFrame(sorted(now), REFERENCE)
        resolved = graph.resolve(old, before)
        done, again = graph.resolve_changes(resolved, new, before, after)
        assert sorted(map(str, done.collect())) == sorted(map(str, graph.resolve(new, after).collect()))
        touched = {(r["file_id"], r["reference_text"]) for r in again.collect()}
        assert touched >= {(30, "n1"), (30, "m9.n2")} and len(touched) < len(now)
        if seed == 2:
            assert touched == {(30, "n1"), (30, "m9.n2")}
