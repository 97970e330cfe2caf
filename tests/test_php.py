from symbolgraph.sources import php

SERVICE = r"""<?php
namespace App\Services;

use App\Contracts\Gateway as Pay;
use App\Models\Order;

abstract class Base { public function log(string $m) { return '} "' . $m; } }

class PaymentService extends Base implements \App\Contracts\Service
{
    use Notifies;
    private Order $order;
    // function commented() {}
    public function __construct(private Pay $gateway, protected int $retries = 3, array $x = [1, 2]) {}
    public function pay(Order $o): ?bool
    {
        $this->gateway->charge($o);
        $o->mark();
        $fresh = new Order();
        $fresh->mark();
        parent::log('x');
        static::helper();
        return $this->log("a{$o}b");
    }
    protected static function helper() { return Order::find(1); }
}
"""
OTHERS = r"""<?php
namespace App\Models; class Model { public static function find($id) {} } class Order extends Model { public function mark(): void {} }
"""
CONTRACT = "<?php\nnamespace App\\Contracts;\ninterface Gateway { public function charge($o); }\n"


def test_php_graph(spark):
    files = spark.createDataFrame([("app/PaymentService.php", SERVICE), ("app/Order.php", OTHERS), ("app/Gateway.php", CONTRACT), ("empty.php", ""), ("null.php", None)], "file string, content string")
    g = php.graph(php.facts(files))
    nodes = {r.id: r for r in g.nodes.collect()}
    pay = "App\\Services\\PaymentService"
    assert nodes[pay].type == "class" and nodes["App\\Contracts\\Gateway"].type == "interface" and nodes["App\\Services\\Base"].is_abstract
    assert nodes[f"{pay}::helper"].visibility == "protected" and nodes[f"{pay}::helper"].is_static and f"{pay}::commented" not in nodes
    edges = {(r.from_id, r.to_id, r.type, r.call_type) for r in g.edges.collect()}
    calls = {(a, b, c) for a, b, t, c in edges if t == "CALLS"}
    assert calls == {
        (f"{pay}::pay", "App\\Contracts\\Gateway::charge", None),
        (f"{pay}::pay", "App\\Models\\Order::mark", None),
        (f"{pay}::pay", "App\\Services\\Base::log", None),
        (f"{pay}::pay", f"{pay}::helper", "STATIC"),
        (f"{pay}::helper", "App\\Models\\Model::find", "STATIC"),
    }
    kinds = {(a, b, t) for a, b, t, _ in edges}
    assert {(pay, "App\\Services\\Base", "EXTENDS"), (pay, "App\\Contracts\\Service", "IMPLEMENTS"), (pay, "App\\Services\\Notifies", "USES_TRAIT"), (pay, "App\\Contracts\\Gateway", "DEPENDS_ON"), (f"{pay}::pay", "App\\Models\\Order", "INSTANTIATES")} <= kinds
