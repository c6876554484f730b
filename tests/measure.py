"""What an action moves, from Spark's own counters."""


def shuffled_rows(spark, act) -> int:
    """Rows that ``act`` writes into shuffles."""
    sc = spark.sparkContext
    store, gateway = sc._jsc.sc().statusStore(), sc._gateway

    def total() -> int:
        stages = store.stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    sc._jsc.sc().listenerBus().waitUntilEmpty()
    before = total()
    act()
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    return total() - before
