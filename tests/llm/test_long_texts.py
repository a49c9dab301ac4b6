"""A text of tens of megabytes in one worker: what is held beside it doesn't grow with it."""

import subprocess
import sys

import pytest

SCRIPT = """
import resource, sys
import numpy as np, pyarrow as pa
from sourceloom.llm import decontaminate, importance, lm_scoring, simhash_dedup as sd, wordhash
text = b" ".join(b"word%d" % (i % 50021) for i in range(7_000_000))
base = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
view = wordhash.utf8(pa.array([text.decode()])[0])
what = sys.argv[1]
if what == "importance":
    raw, _ = importance.tally(iter([(view, True)]))
    out = list(importance.log_importances(iter([(view,)]), importance.log_ratios(raw, raw)))
if what == "decontaminate":
    bench = decontaminate.benchmark_index([(1, " ".join(f"word{i}" for i in range(100, 160))), (2, "no such words at all in here")])
    out = [m[0] for m in decontaminate.scan([view], bench)[0]]
if what == "fingerprint":
    out = [sd.fingerprint(view)]
if what == "set_print":
    out = [sd.set_print(view)[1]]
if what == "lm":
    batch = pa.RecordBatch.from_pydict({"doc_id": [1], "text": [text.decode()]})
    out = [sum(len(t.codes(6)[0]) for t in lm_scoring._normal(iter([batch]), 6)), len(text)]
print(out, len(text) >> 20, (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - base) >> 10)
"""
WANT = {"importance": "[-0.0]", "decontaminate": "[1]", "fingerprint": None, "set_print": "[50021]", "lm": None}


@pytest.mark.parametrize("what", sorted(WANT))
def test_a_long_text_is_read_in_parts(what):
    done = subprocess.run([sys.executable, "-c", SCRIPT, what], capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-800:]
    out, size, more = done.stdout.rsplit(" ", 2)
    print(what, "text of", size, "MB:", more.strip(), "MB more")
    assert int(size) > 60
    assert int(more) < 420  # the text comes in three copies here: as bytes, as str and in Arrow
    if WANT[what]:
        assert out == WANT[what]
    if what == "lm":
        n, chars = eval(out)
        assert n == chars + 1
