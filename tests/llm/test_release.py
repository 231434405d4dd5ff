"""What a pipeline stage leaves behind is returned before the next one."""

from seatwise.llm import common


def test_release_returns_the_drivers_memory(spark, monkeypatch):
    """Garbage, and freed memory of the Python driver and of its JVM."""
    asked = []
    monkeypatch.setattr(common, "give_back", lambda: asked.append("python"))
    trim = common.trim_native_heap
    monkeypatch.setattr(common, "trim_native_heap", lambda s: asked.append(trim(s)))
    common.release(spark)
    assert asked == ["python", True]


def test_every_stage_releases_first(spark, monkeypatch, odd):
    import corpus_pipeline

    class Released(Exception):
        pass

    def stop(_):
        raise Released

    monkeypatch.setattr(corpus_pipeline, "release", stop)
    for _, stage in corpus_pipeline.STAGES:
        try:
            stage(spark, odd, "/nowhere")
        except Released:
            continue
        raise AssertionError(stage.__name__)
