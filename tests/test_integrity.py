import pytest

from watchfold.operators import integrity as I

EDGES = "src_type string, src string, rel string, dst_type string, dst string"


@pytest.fixture
def graph(spark):
    """A sound graph: one correlation of two events, one of them with a source, a server three steps from its site."""
    make = spark.createDataFrame
    tables = {
        "correlations": [("C1", "Zone", "Z1")], "members": [("C1", "E1"), ("C1", "E2"), ("C1", "E2")],
        "events": [("S", "E1", "CYBERSECURITY"), ("S", "E2", "SAFETY")],
        "nodes": [("Server", "S1"), ("Rack", "R1"), ("Zone", "Z1"), ("DataCenter", "D")],
        "edges": [("Event", "E1", "ORIGINATED_FROM", "SourceIP", "10.0.0.1"), ("Server", "S1", "LOCATED_IN", "Rack", "R1"),
                  ("Rack", "R1", "LOCATED_IN", "Zone", "Z1"), ("Zone", "Z1", "PART_OF", "DataCenter", "D")],
        "declared": [("Server", "S1", "LOCATED_IN", "Rack", "R1", True), ("Server", "S1", "LOCATED_IN", "Rack", "R2", False)],
        "expected": [("Server", 1), ("DataCenter", 1)]}
    schemas = {"correlations": "correlation_id string, scope string, shared_entity_id string", "members": "correlation_id string, event_id string",
               "events": "scenario_id string, event_id string, domain string", "nodes": "kind string, id string", "edges": EDGES,
               "declared": EDGES + ", expected boolean", "expected": "kind string, expected long"}

    def found(**changes):
        t = tables | changes
        return sorted(tuple(r) for r in I.graph_violations(*[make(t[n], schemas[n]) for n in schemas_in_order]).collect())

    schemas_in_order = ["correlations", "members", "events", "nodes", "edges", "declared", "expected"]
    found.tables, found.make = tables, lambda name, rows: make(rows, schemas[name])
    return found


def test_a_sound_graph_has_no_violations(graph):
    assert graph() == []


def test_each_rule_finds_its_planted_violation(graph):
    t = graph.tables
    without = lambda name, k: {name: t[name][:k] + t[name][k + 1:]}
    assert graph(**without("events", 1)) == [("MISSING_EVENT", "C1", "E2", 1, 2)]
    assert graph(correlations=t["correlations"] + [("C2", "Zone", "Z1")]) == [("NO_EVENTS", "C2", None, 0, 1)]
    assert graph(correlations=[("C1", "Zone", "Z9")]) == [("SHARED_ENTITY_NOT_UNIQUE", "C1", "Zone:Z9", 0, 1)]
    assert graph(nodes=t["nodes"] + [("Zone", "Z1")]) == [("SHARED_ENTITY_NOT_UNIQUE", "C1", "Zone:Z1", 2, 1)]
    assert graph(correlations=[("C1", "Rack", "Z1")]) == [("SHARED_ENTITY_NOT_UNIQUE", "C1", "Rack:Z1", 0, 1)]
    assert graph(**without("edges", 0)) == [("MISSING_SOURCE_LINK", "E1", "ORIGINATED_FROM:SourceIP", 0, 1)]
    wrong = [("Event", "E1", "ORIGINATED_FROM", "Server", "S1"), ("Event", "E1", "TARGETS", "SourceIP", "x"), ("Server", "E1", "ORIGINATED_FROM", "SourceIP", "x")]
    assert graph(edges=t["edges"][1:] + wrong) == [("MISSING_SOURCE_LINK", "E1", "ORIGINATED_FROM:SourceIP", 0, 1)]
    assert graph(**without("edges", 1)) == [("BROKEN_PLACEMENT", "S1", "DataCenter", 0, 1), ("MISSING_RELATIONSHIP", "S1", "LOCATED_IN:Rack:R1", 0, 1)]
    second = [("Server", "S1", "LOCATED_IN", "Rack", "R2")]
    assert graph(edges=t["edges"] + second) == [("FORBIDDEN_RELATIONSHIP", "S1", "LOCATED_IN:Rack:R2", 1, 0)]
    other = [("Rack", "R1", "LOCATED_IN", "Zone", "Z2"), ("Zone", "Z2", "PART_OF", "DataCenter", "D2")]
    assert graph(edges=t["edges"] + other) == [("BROKEN_PLACEMENT", "S1", "DataCenter", 2, 1)]
    assert graph(edges=t["edges"] * 2) == []
    assert graph(expected=[("Server", 2), ("Camera", 0), ("Person", 3)]) == [("NODE_COUNT", "Person", None, 0, 3), ("NODE_COUNT", "Server", None, 1, 2)]


def test_scenario_status(spark, graph):
    t = graph.tables
    expected = spark.createDataFrame([("S", "E1"), ("S", "E2"), ("T", "E9"), ("S", "E1")], "scenario_id string, event_id string")
    run = lambda edges: {r.scenario_id: (r.status, r.expected_events, r.observed_events, r.missing_events, r.unlinked_events)
                         for r in I.scenario_status(expected, graph.make("events", t["events"]), graph.make("edges", edges)).collect()}
    assert run(t["edges"]) == {"S": ("PASS", 2, 2, 0, 0), "T": ("INCOMPLETE", 1, 0, 1, 0)}
    assert run(t["edges"][1:])["S"] == ("INCOMPLETE", 2, 2, 0, 1)
