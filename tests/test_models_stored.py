"""Models and event tables written by one job and read by another."""

import pytest

from driftwatch.plans.assess import Model, assess, learn, unassessed
from driftwatch.schema import EVENT_SCHEMA
from driftwatch.sources.models import load_model, read_events, save_model
from driftwatch.sources.telemetry import profile_events, scoring_events, telemetry, training_events


def rows(df):
    return sorted(map(str, df.collect()))


def test_loaded_model_scores_like_the_one_saved(spark, sf_dir, tmp_path):
    model = learn(profile_events(spark, sf_dir), training_events(spark, sf_dir), n_estimators=5)
    save_model(model, f"{tmp_path}/full")
    loaded = load_model(spark, f"{tmp_path}/full")
    assert (loaded.forest.sample, loaded.forest.threshold) == (model.forest.sample, model.forest.threshold)
    events = scoring_events(spark, sf_dir)
    assert rows(assess(events, loaded)) == rows(assess(events, model))

    save_model(Model(model.baseline), f"{tmp_path}/rules")
    assert load_model(spark, f"{tmp_path}/rules").forest is None
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        save_model(model, f"{tmp_path}/rules")


def test_every_event_is_assessed_or_listed(spark, sf_dir):
    profile = profile_events(spark, sf_dir).filter("entity_type = 'user'")
    learnt = learn(profile, profile, n_estimators=2)
    events = scoring_events(spark, sf_dir)
    left = unassessed(events, learnt).count()
    assert left > 0 and assess(events, learnt).count() + left == events.count()


@pytest.mark.parametrize("form", ["parquet", "json"])
def test_event_tables_are_read_under_the_schema(spark, sf_dir, tmp_path, form):
    events = telemetry(spark, sf_dir).select(*EVENT_SCHEMA.names)
    events.write.format(form).option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").save(f"{tmp_path}/{form}")
    found = read_events(spark, f"{tmp_path}/{form}", form)
    assert found.schema == EVENT_SCHEMA
    assert rows(found) == rows(events)
