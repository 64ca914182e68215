"""What an executed plan did, read from its metrics."""


def nodes(plan):
    """All nodes of an executed plan, the final one under adaptive execution."""
    name = plan.nodeName()
    if name == "AdaptiveSparkPlan":
        yield from nodes(plan.executedPlan())
        return
    if name.endswith("QueryStage"):
        yield from nodes(plan.plan())
        return
    yield plan
    children = plan.children()
    for i in range(children.size()):
        yield from nodes(children.apply(i))


def metric(node, name):
    found = node.metrics().get(name)
    return found.get().value() if found.isDefined() else None


def executed(df):
    """Runs the query and gives its nodes."""
    query = df._jdf.queryExecution()
    query.executedPlan().executeCollect()
    return list(nodes(query.executedPlan()))


def shuffled_records(df):
    return [metric(n, "shuffleRecordsWritten") for n in executed(df) if n.nodeName() == "Exchange"]
