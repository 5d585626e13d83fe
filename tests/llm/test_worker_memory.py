"""Memory that a Python worker keeps after a task."""

import subprocess
import sys
from pathlib import Path

import pytest

RUN = """
import random, re, sys
import pyarrow as pa
from tablescope.llm import packing, tokens
from tablescope.llm.common import tidy

def held():
    return sum(map(int, re.findall(r"\\nPss_(?:Anon|Shmem):\\s+(\\d+)", open("/proc/self/smaps_rollup").read()))) / 1024

class Task:
    get = classmethod(lambda cls: cls())
    partitionId = lambda self: 0

packing.TaskContext = Task
path = tokens.default_path()
rng = random.Random(5)
words = ["".join(rng.choices("abcdefghij", k=6)) for _ in range(2000)]
pick = lambda n: " ".join(rng.choices(words, k=n))
batches = lambda k: (pa.RecordBatch.from_pydict({"doc_id": range(100), "text": [pick(6000) for _ in range(100)]}) for _ in range(k))
run = packing._measure(path, 1024)
for out in run(pa.RecordBatch.from_pydict({"doc_id": [1], "text": [" ".join(words)]}) for _ in range(1)):
    pass
before = held()
for out in (tidy(run) if sys.argv[1] == "tidy" else run)(batches(5)):
    pass
del out
print(held() - before)
"""


@pytest.mark.skipif(not Path("/proc/self/smaps_rollup").exists(), reason="memory can't be read here")
def test_a_worker_gives_its_free_memory_back():
    left = {how: float(subprocess.run([sys.executable, "-c", RUN, how], cwd=Path(__file__).parents[2], capture_output=True,
                                      text=True, check=True).stdout) for how in ("plain", "tidy")}
    assert left["tidy"] < 25 and left["tidy"] < left["plain"] / 2, left


def test_steps_of_the_pipeline_are_tidy(spark, monkeypatch):
    from tablescope.llm import language_crf, packing, simhash
    used = []
    for module in (language_crf, packing, simhash):
        monkeypatch.setattr(module, "tidy", lambda run, name=module.__name__: used.append(name.rsplit(".", 1)[1]) or run)
    df = spark.createDataFrame([(1, "one two three four"), (2, "five six seven")], "doc_id long, text string")
    assert packing.pack(df).count() == 2 and simhash.simhash_dedup(df).count() == 2
    assert language_crf.predict(df, None).count() == 2
    assert {x: used.count(x) for x in used} == {"packing": 3, "simhash": 3, "language_crf": 1}
