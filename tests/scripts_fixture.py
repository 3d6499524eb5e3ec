"""Small programs for the extractor tests, one feature each."""

# Paths reach load() through a constructor argument, an attribute and a dict entry.
ATTRIBUTE_PATHS = '''
class Feed:
    def __init__(self, engine, places):
        self.engine = engine
        self.places = places

    def north(self):
        return self.engine.open().load(self.places["n"])

    def south(self):
        return self.engine.open().load(self.places["s"])


where = {"n": "mem://north", "s": "mem://south"}
feed = Feed(make_engine(), where)
feed.north()
feed.south()
'''

# A table name is put together from two parameters of a function called twice.
NAMED_TABLES = '''
def store(rows, area, label):
    rows.saveAsTable(f"{area}.{label}")

store(a, "lab", "trials")
store(b, label="scores", area="lab")
'''

# The same with a name that nothing defines.
UNDEFINED_PART = NAMED_TABLES.replace("{label}", "{missing}")

# The same call in three arms.
THREE_ARMS = '''
if mode == 1:
    load("mem://same")
elif mode == 2:
    load("mem://same")
else:
    load("mem://same")
'''

# A function that is defined but never called, plus one top-level call.
UNCALLED = ["def helper(v): emit(v); emit(7)", "emit('hello')"]
