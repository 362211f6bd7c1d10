"""What the driver sees of this subpackage."""

import pathlib
import subprocess
import sys

import __spark_entry__ as registry
import corpus_pipeline
from loomset.llm import catalog, oracle

ROOT = pathlib.Path(__file__).resolve().parents[2]


def test_all_operators_are_registered():
    names = set(registry.queries())
    assert sorted(int(n[2:].split("_")[0]) for n in names if n.startswith("op")) == list(range(1, 14))
    assert "pipeline" in names and set(oracle.SQL) <= set(catalog.QUERIES)
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "quality rules",
        "SimHash near-dedup",
        "suffix-array dedup",
        "mixing to target weights",
        "SentencePiece encoding",
    ]


def test_library_works_without_the_subpackage(tmp_path):
    for path in ROOT.rglob("*.py"):
        inside = path.relative_to(ROOT)
        if "llm" not in inside.parts and inside.name != "corpus_pipeline.py":
            copy = tmp_path / inside
            copy.parent.mkdir(parents=True, exist_ok=True)
            copy.write_text(path.read_text())
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(n.startswith('op') or n == 'pipeline' for n in q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)


def test_nothing_else_imports_the_subpackage():
    for path in [*(ROOT / "loomset").rglob("*.py"), *(ROOT / "tests").glob("*.py"), ROOT / "bench.py"]:
        if "llm" not in path.relative_to(ROOT).parts:
            assert "llm" not in path.read_text().replace("test_llm", ""), path
