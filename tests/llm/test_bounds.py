"""Memory of slices, and tasks on workers that do not have the package."""

import os
import subprocess
import sys
import tracemalloc

import pyarrow as pa

from pairloom.llm import kernels, minhash

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def test_short_texts_are_signed_in_bounded_slices():
    texts = [f"w{i} of short text" if i % 2 else f"a{i} b" for i in range(2000)]
    batch = pa.RecordBatch.from_pydict({"text": texts})
    parts = list(kernels.slices(batch, "text", rows=minhash.SLICE_TEXTS))
    assert sum(p.num_rows for p in parts) == 2000
    assert max(p.num_rows for p in parts) == minhash.SLICE_TEXTS
    tracemalloc.start()
    try:
        for part in parts[:2]:
            minhash.signatures(*minhash._text_shingles(part, "text"))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 200 << 20


def test_slices_are_whole_without_a_bound_on_rows():
    batch = pa.RecordBatch.from_pydict({"text": ["abc", None, "", "x" * 50, "y"] * 20})
    parts = list(kernels.slices(batch, "text", limit=60))
    assert pa.Table.from_batches(parts).column("text").to_pylist() == batch.column("text").to_pylist()


def test_operators_run_where_workers_lack_the_package(tmp_path):
    """Near duplicates and decontamination from another folder, the package on the driver's path only."""
    code = (
        f"import sys; sys.path.insert(0, {ROOT!r})\n"
        "from pairloom.llm.registry import LLM_QUERIES\n"
        "from pairloom.session import build_session\n"
        "s = build_session('local[4]', **{'spark.sql.shuffle.partitions': '2', 'spark.ui.enabled': 'false'})\n"
        "for n in ('op4_decontamination', 'op1_minhash', 'op10_lm_scoring'):\n"
        "    print(LLM_QUERIES[n](s, '/root/testdata/sf0.001').count())\n"
    )
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    run = subprocess.run(
        [sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=400
    )
    assert run.returncode == 0, run.stderr[-2000:]
    assert run.stdout.split()[-3:] == ["200"] * 3


def test_language_model_decodes_one_chunk_at_a_time():
    import pyarrow as pa

    from pairloom.llm.language_model import rows_of

    batch = pa.RecordBatch.from_pydict({"chunk": [1, 2, 3], "sizes": [[1], None, [2, 3]]})
    assert next(iter(rows_of(batch))) == {"chunk": 1, "sizes": [1]}
    assert list(rows_of(batch)) == batch.to_pylist()
