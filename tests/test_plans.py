"""Plans that are meant to stay as they are: few shuffles, pruned scans, pushed filters."""

import contextlib
import io
import re

import pytest

from cuemill.plans import catalog

SF = "/root/testdata/sf0.001"


def plan(spark, name):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        catalog.queries()[name](spark, SF).explain()
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    return out.getvalue()


@pytest.mark.parametrize("name,shuffles", [("w1_cue_ranges", 1), ("w2_cue_times", 1), ("t3_wrapped_cues", 1), ("st6_file_states", 1), ("st6_progress_bars", 1), ("a2_outcomes", 1), ("v1_word_faults", 1), ("l1_job_page", 0), ("t2_collapse", 0), ("h2_content_ids", 0), ("p27_judged_edits", 0)])
def test_shuffles(spark, name, shuffles):
    assert len(re.findall(r"\bExchange ", plan(spark, name))) == shuffles


def test_scans_are_pruned(spark):
    assert "ReadSchema: struct<conv_id:bigint,turn:bigint,role:string,text:string>" in plan(spark, "w1_cue_ranges")
    assert "ReadSchema: struct<event_id:bigint,user_id:bigint,event_type:string>" in plan(spark, "st6_file_states")
    assert "GreaterThan(event_id,900)" in plan(spark, "st2_replay")


@pytest.mark.parametrize("name", list(catalog.queries()))
def test_no_python_and_no_cartesian(spark, name):
    text = plan(spark, name)
    assert not re.search(r"Python|Pandas|InArrow|CartesianProduct", text)
