"""Selection goes on while a feature helps."""

from clonoscope.plans import learned


def test_forward_select_may_take_every_feature(monkeypatch):
    asked = []

    class Spark:
        def createDataFrame(self, rows, schema):
            return rows

    monkeypatch.setattr(learned, "table_of_features", lambda spark, d: None)
    monkeypatch.setattr(learned, "forward_selection", lambda rows, names, most: asked.append(most) or [])
    learned.forward_select(Spark(), "")
    assert asked == [len(learned.FEATURES)]
