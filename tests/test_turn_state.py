"""What a wake-up of a turn's state costs."""

from answerscope.streaming.turns import Watchdog


class Counted:
    """A handle and its states, which count their calls."""

    def __init__(self):
        self.calls, self.value, self.list = 0, None, []

    def getListState(self, name, schema):
        return self

    def getValueState(self, name, schema):
        of, outer = type("Value", (), {}), self
        value = of()
        value.value = None

        def get():
            outer.calls += 1
            return value.value

        def update(x):
            outer.calls += 1
            value.value = x

        value.get, value.update, value.clear, value.exists = get, update, lambda: update(None), lambda: get() is not None
        return value

    def registerTimer(self, ms):
        self.calls += 1

    def exists(self):
        self.calls += 1
        return bool(self.list)

    def get(self):
        self.calls += 1
        return iter(self.list)

    def appendValue(self, x):
        self.calls += 1
        self.list.append(x)

    def appendList(self, xs):
        self.calls += 1
        self.list += xs

    def clear(self):
        self.calls += 1
        self.list = []

    def getCurrentWatermarkInMs(self):
        return 10**6


def test_rows_that_are_due_cost_no_call_each():
    handle, w = Counted(), Watchdog(1000)
    w.init(handle)
    list(w.handleInputRows(("k",), [{"us": k, "tie": k} for k in range(500)], handle))
    out = list(w.handleExpiredTimer(("k",), handle, None))
    assert [(r["id"], r["timed_out"]) for r in out] == [(k, k == 499) for k in range(500)]
    assert handle.calls < 12
