from fractions import Fraction

from pyspark.sql import functions as F

from marginalia.llm import mixing

from .helpers import odd_docs


def simulate(blocks, weights, slots):
    """Slot by slot earliest deadline first, phase by phase: (slot, source, block)."""
    done, out, t0 = dict.fromkeys(blocks, 0), [], 0
    live = {s for s, n in blocks.items() if n}
    while live:
        got = mixing.shares({s: weights[s] for s in sorted(live)}, slots)
        d = sum(got.values())
        here, t = dict.fromkeys(live, 0), 0
        while all(done[s] < blocks[s] for s in live):
            free = [(-(-(here[s] % got[s] + 1) * d // got[s]) + here[s] // got[s] * d, got[s], s) for s in live if here[s] % got[s] * d // got[s] + here[s] // got[s] * d <= t]
            _, _, s = min(free)
            out.append((t0 + t, s, done[s]))
            done[s] += 1
            here[s] += 1
            t += 1
        t0 += t
        live = {s for s in live if done[s] < blocks[s]}
    return out


def placed(plan):
    return sorted((start + i // len(p) * d + p[i % len(p)], s, lo + i) for _, start, s, lo, here, d, p in plan for i in range(here))


def test_schedule_is_edf_with_less_than_one_block_of_lag():
    blocks, weights = {"a": 40, "b": 7, "c": 19, "e": 0, "f": 1}, {"a": 5.0, "b": 1.5, "c": 0.7, "e": 1.0, "f": 3.3}
    got = placed(mixing.phases(blocks, weights, 50))
    assert got == simulate(blocks, weights, 50) and [t for t, *_ in got] == list(range(67))
    share = mixing.shares({s: weights[s] for s in "abcf"}, 50)
    d, n = sum(share.values()), dict.fromkeys("abcf", 0)
    for t, s, _ in got:
        n[s] += 1
        if n["f"] == 1 and s == "f":
            break
        assert all(abs(n[x] - Fraction(share[x] * (t + 1), d)) < 1 for x in n)


def test_every_row_once_in_the_scheduled_order(spark):
    rows = [(i, "ab"[i % 7 == 0] if i % 11 else None) for i in range(1000)]
    d = spark.createDataFrame(rows, "doc_id long, source string")
    got = mixing.mix_sources(d, {"a": 1, "b": 2, None: 1}, block=4, slots=20, bucket_rows=50).collect()
    assert sorted(r.position for r in got) == list(range(1000)) and sorted(r.doc_id for r in got) == list(range(1000))
    name = {None: "", "a": "=a", "b": "=b"}
    count = {k: sum(name[s] == k for _, s in rows) for k in ("", "=a", "=b")}
    want = {(s, b): t for t, s, b in placed(mixing.phases({k: -(-n // 4) for k, n in count.items()}, {"=a": 1, "=b": 2, "": 1}, 20))}
    assert all(want[name[r.source], r.block] == r.slot for r in got)
    by = sorted(got, key=lambda r: r.position)
    assert [r.slot for r in by] == sorted(r.slot for r in got)


def test_in_order_and_odd(spark):
    d = odd_docs(spark)
    got = mixing.mix_sources(d, in_order=True)
    parts = got.withColumn("p", F.spark_partition_id()).select("p", "position").collect()
    assert [r.position for r in sorted(parts, key=lambda r: r.p)] == list(range(12))
    assert set(d.columns) <= set(got.columns) and dict(got.dtypes)["position"] == "bigint"
    assert mixing.mix_sources(d.limit(0)).count() == 0 and mixing.mix_sources(d.limit(0), in_order=True).count() == 0


def test_lag_is_under_a_block_by_the_given_weights():
    rows = {"hot": 3_000_000, **{f"s{i:02}": 300_000 for i in range(20)}}
    blocks, weights = {s: -(-n // 32) for s, n in rows.items()}, {s: n**0.7 for s, n in rows.items()}
    plan = [r for r in mixing.phases(blocks, weights) if r[0] == 0]
    total = sum(map(Fraction, weights.values()))
    got, n = placed(plan), dict.fromkeys(rows, 0)
    assert [t for t, *_ in got] == list(range(len(got)))
    for t, s, _ in got:
        n[s] += 1
        assert t % 97 or all(abs(k - Fraction(weights[x]) / total * (t + 1)) < 1 for x, k in n.items())


def test_a_small_source_keeps_its_weight():
    blocks = {"big": 20_000, "small": 1000}
    got = placed([r for r in mixing.phases(blocks, {"big": 0.9992, "small": 0.0008}) if r[0] == 0])
    assert abs(sum(s == "small" for _, s, _ in got) - 0.0008 * len(got)) < 1


def test_rows_without_a_key_are_spread(spark):
    rows = [(None, "a")] * 3000 + [(7, "a")] * 500 + [(i, "b") for i in range(300)]
    d = spark.createDataFrame(rows, "doc_id long, source string")
    got = mixing.mix_sources(d, block=4, bucket_rows=50)
    assert sorted(r.position for r in got.collect()) == list(range(3800)) and got.groupBy("doc_id").count().where("doc_id is null").first()["count"] == 3000

