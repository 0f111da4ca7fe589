"""Functions by name in SQL work out what they judge once."""

from infratrace.functions import sql


def test_refanging_is_named_once():
    body = next(b for s, b in sql.FUNCTIONS.items() if s.startswith("normalize_indicator"))
    assert body.count("refang(v)") == 1  # nine times before
