"""The derived instance table: one exchange, and hot suppliers agree with ordinary ones."""
from catalog import views as v


def shuffled_records(spark, run):
    store, gateway = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway

    def total():
        found, out = store.stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), None).iterator(), 0
        while found.hasNext():
            out += found.next().shuffleWriteRecords()
        return out
    before = total()
    run()
    return total() - before


def test_instance_table_moves_a_line_item_once_and_hot_suppliers_agree(spark):
    sf = "/root/testdata/sf0.001"
    n = v.table(spark, sf, "lineitem").count()
    suppliers = v.table(spark, sf, "supplier").count()
    assert shuffled_records(spark, lambda: v.build_instances(spark, sf).write.format("noop").mode("overwrite").save()) <= n + 16 * suppliers
    a, b = v.build_instances(spark, sf), v.build_instances(spark, sf, hot_rows=100)
    assert a.count() == n and a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
