import __spark_entry__ as e


def test_names_and_sql():
    q, s = e.queries(), e.oracle_sql()
    assert set(s) <= set(q) and len(q) > 50
    assert not any(n in text for text in s.values() for n in ("limit 100", "sample"))


def test_core_does_not_import_the_training_text_package():
    from pathlib import Path

    root = Path(e.__file__).parent / "glossmill"
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert "glossmill.llm" not in p.read_text(encoding="utf-8"), p
