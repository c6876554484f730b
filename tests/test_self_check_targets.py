"""self_check: a target that all sites share is looked up once; no task reads all sites."""

from factloom.operators import diagnose


def most_read(spark, act) -> int:
    """The most rows that a task of ``act`` reads from shuffles."""
    sc = spark.sparkContext
    store, gateway = sc._jsc.sc().statusStore(), sc._gateway

    def stages():
        found = store.stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
        return {found.apply(i).stageId(): found.apply(i).attemptId() for i in range(found.size())}

    sc._jsc.sc().listenerBus().waitUntilEmpty()
    before = stages()
    act()
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    most = 0
    for stage, attempt in stages().items():
        if stage not in before:
            tasks = store.taskList(stage, attempt, 1000)
            read = [tasks.apply(i).taskMetrics() for i in range(tasks.size())]
            most = max([most, *[m.get().shuffleReadMetrics().recordsRead() for m in read if m.isDefined()]])
    return most


def test_a_shared_target_is_looked_up_once(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        res = spark.range(4000).selectExpr("id call_site_id", "'partial' status", "cast(null as string) unknown_scope", "array(case when id % 100 = 1 then null when id % 100 = 2 then 9 else 5 end) target_definition_ids")
        sites = spark.range(4000).selectExpr("id call_site_id", "cast(null as long) derived_from")
        nodes, edges = spark.createDataFrame([(5,)], "definition_id int"), spark.createDataFrame([], "caller_id int, callee_id int, evidence_id int")
        none = spark.createDataFrame([], "definition_id string, n_blockers int")
        check = lambda r: diagnose.self_check(r, sites, nodes, edges, none, none.select("definition_id"))
        got = check(res).collect()
        assert sorted((r.code, int(r.subject)) for r in got) == sorted(("resolution_target_missing", i) for i in range(4000) if i % 100 in (1, 2))
        sound = res.filter("call_site_id % 100 not in (1, 2)")
        assert most_read(spark, lambda: check(sound).write.format("noop").mode("overwrite").save()) < 3000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
