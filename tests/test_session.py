"""Scratch folders and their scopes."""

import os

import pytest

from statspine.session import outlives, scratch_dir, scratch_scope


def made(spark, purpose):
    folder = scratch_dir(spark, purpose)
    os.makedirs(folder)
    return folder


def test_a_scope_deletes_what_was_named_inside(spark):
    before = made(spark, "before")
    with scratch_scope(spark):
        inside, result = made(spark, "inside"), made(spark, "result")
        outlives(result)
        scratch_dir(spark, "never-made")
        with scratch_scope(spark):
            inner, handed = made(spark, "inner"), made(spark, "handed")
            outlives(handed)
        assert not os.path.exists(inner) and os.path.exists(handed)
    assert [os.path.exists(p) for p in (before, inside, result, handed)] == [True, False, True, False]


def test_a_scope_ends_with_its_step(spark):
    with pytest.raises(ValueError), scratch_scope(spark):
        inside = made(spark, "inside")
        raise ValueError
    assert not os.path.exists(inside) and os.path.exists(made(spark, "after"))
