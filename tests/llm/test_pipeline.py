import hashlib
import math
import pathlib
import random
from collections import Counter, defaultdict

import corpus_pipeline
import pytest

from caregauge.session import staging

from .conftest import EXTRA
from .test_exactdedup import norm
from .test_mixing import WORD, expected_targets
from .test_neardup import classes
from .test_packing import whole


def write(spark, folder, rows):
    columns = "doc_id long, text string, source string, lang string, " + ", ".join(f"`{c.replace('`', '``')}` string" for c in EXTRA)
    spark.createDataFrame(rows, columns).write.parquet(f"{folder}/documents.parquet")


def mixed(rows):
    """Plain systematic sampling over (doc_id, text, source)."""
    by_source = defaultdict(list)
    for i, t, s in rows:
        by_source[s].append((-len(WORD.findall(t or "")), i, t))
    sizes = {s: -sum(n for n, _, _ in own) for s, own in by_source.items()}
    out = Counter()
    for s, target in expected_targets(sizes).items():
        rate = target / sizes[s] if sizes[s] else 0.0
        name = "\0" if s is None else s
        shift = int(hashlib.md5(f"mix-1:{name}".encode()).hexdigest()[:5], 16) / 2**20
        for place, (_, i, t) in enumerate(sorted(by_source[s], key=lambda r: r[:2])):
            out[(i, t, s)] += math.floor((place + 1) * rate + shift) - math.floor(place * rate + shift)
    return Counter({k: n for k, n in out.items() if n})


def test_every_stage_equals_its_plain_version(spark, texts, tmp_path):
    rng = random.Random(3)
    rows = [
        (i, t, rng.choice(["b", "a", None, "c"]), rng.choice(["en", "de"]) if t else None, *EXTRA) for i, t in enumerate(texts)
    ]
    write(spark, tmp_path, rows)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    before = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "language_id", "exact_dedup", "near_dedup", "mix_sources", "pack_sequences",
    ]
    for name, stage in corpus_pipeline.STAGES:
        path = f"{tmp_path}/{name}"
        stage(spark, docs, str(tmp_path)).write.parquet(path)
        out = spark.read.parquet(path)
        if name == "pack_sequences":
            pieces = Counter((r.doc_id, r.piece, r.length) for r in out.collect())
            wanted = Counter()
            for (i, _, _), ids in zip(before, whole([t for _, t, _ in before]), strict=True):
                first = len(ids) % 2048 or 2048
                wanted.update((i, n, 2048 if n else first) for n in range(1 + (len(ids) - first) // 2048))
            assert pieces == wanted
            break
        assert out.columns == docs.columns
        # Each extra column holds its own name in every row, whatever the stage calls its own columns.
        assert all(tuple(r)[4:] == EXTRA for r in out.collect())
        after = [(r.doc_id, r.text, r.source) for r in out.collect()]
        if name == "language_id":
            assert sorted(map(str, after)) == sorted(str(r) for r in before if any(c.isalpha() for c in r[1] or ""))
        elif name == "exact_dedup":
            first = {}
            for i, t, _ in before:
                first[norm(t)] = min(i, first.get(norm(t), i))
            assert sorted(i for i, _, _ in after) == sorted(first.values())
        elif name == "near_dedup":
            groups = classes([(i, t) for i, t, _ in before])
            assert {i for i, _, _ in after} == {min(before[m][0] for m in members) for members in groups.values()}
            assert len(after) == len({i for i, _, _ in after}) < len(before)
        else:
            assert Counter(after) == mixed(before)
        docs, before = out, after
    again = Counter((r.doc_id, r.piece, r.length) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    assert again == pieces


def test_finished_stages_are_not_run_again(spark, texts, tmp_path, monkeypatch):
    write(spark, tmp_path, [(i, t, "a", "en", *EXTRA) for i, t in enumerate(texts)])
    ran = []

    def watched(name, stage, broken=()):
        def run(*args):
            ran.append(name)
            if name in broken:
                raise OSError("driver lost")
            return stage(*args)

        return name, run

    stages = corpus_pipeline.STAGES
    names = [name for name, _ in stages]
    folder = f"{tmp_path}/run"
    monkeypatch.setattr(corpus_pipeline, "STAGES", [watched(*s, broken=("mix_sources",)) for s in stages])
    with pytest.raises(OSError):
        corpus_pipeline.run(spark, str(tmp_path), folder)
    monkeypatch.setattr(corpus_pipeline, "STAGES", [watched(*s) for s in stages])
    once = sorted(map(repr, corpus_pipeline.run(spark, str(tmp_path), folder).collect()))
    assert ran == [*names[:4], *names[3:]]
    assert sorted(map(repr, corpus_pipeline.run(spark, str(tmp_path), folder).collect())) == once and len(ran) == 6


def test_copies_go_with_the_staging_block(spark, texts, tmp_path):
    write(spark, tmp_path, [(i, t, "a", "en", *EXTRA) for i, t in enumerate(texts[:9])])
    with staging(spark):
        (file,) = {f.rsplit("/", 2)[0] for f in corpus_pipeline.run(spark, str(tmp_path)).inputFiles()}
        folder = pathlib.Path(file.removeprefix("file:"))
        assert folder.exists()
    assert not folder.exists()


def test_nothing(spark, tmp_path):
    write(spark, tmp_path, [])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_rows_of_nulls(spark, tmp_path):
    write(spark, tmp_path, [tuple([None] * (4 + len(EXTRA)))] * 2 + [(1, "some words here", None, None, *EXTRA)])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0  # no language could be learned
