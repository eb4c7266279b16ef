"""The driver contract: keys, docstrings, oracle coverage."""

import __spark_entry__ as entry


def test_every_oracle_key_is_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_every_query_is_documented():
    for name, fn in entry.queries().items():
        assert fn.__doc__ and fn.__doc__.strip(), name


def test_training_data_keys_only_with_their_subpackage():
    """The entry adds opN_ keys and the pipeline only where riskroll.llm is installed beside it."""
    import importlib.util

    names = [k for k in entry.queries() if k == "pipeline" or k.startswith("op") and k[2:3].isdigit()]
    assert bool(names) == (importlib.util.find_spec("riskroll.llm") is not None)
    assert set(entry.oracle_sql()) <= set(entry.queries())
