import subprocess
import sys
import textwrap

REPO = __file__.rsplit("/tests/", 1)[0]


def test_imports_without_the_llm_folders():
    code = textwrap.dedent("""
        import importlib.abc, sys
        class Gone(importlib.abc.MetaPathFinder):
            def find_spec(self, name, path=None, target=None):
                if name == "corpus_pipeline" or name.startswith("marginalia.llm"):
                    raise ModuleNotFoundError(name, name=name)
        sys.meta_path.insert(0, Gone())
        import __spark_entry__ as e
        assert len(e.queries()) > 60 and not any(k.startswith("op") and k[2].isdigit() for k in e.queries()) and "pipeline" not in e.queries()
        assert set(e.oracle_sql()) <= set(e.queries())
    """)
    subprocess.run([sys.executable, "-c", code], cwd=REPO, check=True)


def test_entry(spark):
    sys.path.insert(0, REPO)
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
