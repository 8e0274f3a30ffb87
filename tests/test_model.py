import json

import pytest

from tidemark.sources import model

GOOD = {"found": True, "title": "Fest", "start": "2026-05-02T20:00", "all_day": False}


@pytest.mark.parametrize("answer, fine", [(GOOD, True), ({"found": False}, True), (GOOD | {"extra": 1}, False), (GOOD | {"title": ""}, False), (GOOD | {"start": 5}, False), ([], False), ("x", False)])
def test_answers_are_checked(answer, fine):
    assert (model.checked(json.dumps(answer)) is not None) == fine


def test_formats_are_tried_in_turn():
    seen = []

    def backend(_, how):
        seen.append(how and how["type"])
        if how:
            raise model.FormatUnsupported
        return "{}"

    assert model.ask(backend, "x") == "{}" and seen == ["json_schema", "json_object", None]
    assert model.rejects_format("response_format is not supported", 400) and not model.rejects_format("response_format is not supported", 500) and not model.rejects_format("slow down")


def test_only_misses_are_asked(spark):
    pages = spark.createDataFrame([("s", f"https://x/{i}", f"<body><script>no</script><p>Fest {i}</p></body>") for i in range(3)], "source_id string, url string, body string")

    def backend(messages, _):
        assert "no" not in messages[1]["content"].split()
        return json.dumps(GOOD | {"title": messages[1]["content"].split("\n")[1]})

    cache = spark.createDataFrame([], "cache_key string, result_json string")
    found, new = model.extract(pages, cache, backend, "m")
    assert sorted(r.title for r in found.collect()) == ["Fest 0", "Fest 1", "Fest 2"] and new.count() == 3
    again, none = model.extract(pages, new, None, "m")
    assert again.count() == 3 and none.count() == 0
    assert found.first().extraction_confidence == 0.6
