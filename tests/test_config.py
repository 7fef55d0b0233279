from datetime import date

import pytest

from adlift.config import FIXTURE_CONFIG, LaunchConfig, windows


def test_reference_windows_differ_in_length():
    # before = N days, after = N + 1 days
    bs, be, n = windows(date(2026, 3, 18), date(2026, 4, 17))
    assert n == 30
    assert be == date(2026, 3, 17)
    assert (be - bs).days + 1 == 30
    assert (date(2026, 4, 17) - date(2026, 3, 18)).days + 1 == 31


def test_equal_window_policy():
    bs, be, n = windows(date(2026, 3, 18), date(2026, 4, 17), "equal")
    assert (be - bs).days + 1 == 31


def test_end_equal_to_launch_and_launch_plus_two():
    assert windows(date(2020, 1, 10), date(2020, 1, 10)) == (date(2020, 1, 9), date(2020, 1, 9), 1)
    bs, be, n = windows(date(2020, 1, 10), date(2020, 1, 12))
    assert n == 2 and bs == date(2020, 1, 8) and be == date(2020, 1, 9)


def test_end_before_launch_clamps_to_one_day():
    bs, be, n = windows(date(2020, 1, 10), date(2020, 1, 5))
    assert n == 1 and be == date(2020, 1, 9) and bs == date(2020, 1, 9)


def test_bad_policy():
    with pytest.raises(ValueError):
        windows(date(2020, 1, 1), date(2020, 2, 1), "x")


def test_fixture_config():
    c = FIXTURE_CONFIG
    assert c.days_after == 183
    assert c.before_start == date(1998, 12, 30)
    assert c.before_end == date(1999, 6, 30)
    assert c.history_end == date(1999, 6, 30)
    rec = c.as_record()
    assert rec["non_endemic"] == sorted(rec["non_endemic"])
    assert rec["oo_start"] == "1999-07-01"


def test_config_accepts_text_dates():
    c = LaunchConfig("2026-03-18", "2026-04-17", "2025-03-18")
    assert c.launch_date == date(2026, 3, 18)
