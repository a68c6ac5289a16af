"""State is read and written once for the rows of a key, not once for each."""

from collections import Counter

from pyspark.sql import Row

from paperloom.streaming import progress


class Store:
    def __init__(self):
        self.calls, self.kept = Counter(), []

    def getListState(self, *_):
        return self

    def get(self):
        self.calls["get"] += 1
        return iter(self.kept)

    def appendList(self, rows):
        self.calls["append"] += 1
        self.kept += rows


def test_deliveries_call_the_store_twice():
    store, processor = Store(), progress.Deliveries(1000)
    processor.init(store)
    rows = [Row(event_id=k % 300) for k in range(1000)]
    assert [r.event_id for r in processor.handleInputRows((1,), iter(rows), None)] == list(range(300))
    assert list(processor.handleInputRows((1,), iter(rows), None)) == [] and store.calls == {"get": 2, "append": 1}
