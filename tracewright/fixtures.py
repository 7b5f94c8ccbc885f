"""Small literal inputs for queries whose operators read code, which the driver's tables don't hold."""

from __future__ import annotations

DDL = [
    ("a.sql", """CREATE TABLE IF NOT EXISTS SALES."ORDERS" (
  "ID" NUMBER(10,2) NOT NULL,
  CUST_ID INTEGER,
  NOTE VARCHAR(20) DEFAULT 'x',
  CONSTRAINT ck CHECK (ID > 0)
);
COMMENT ON TABLE SALES."ORDERS" IS 'what was ordered';
COMMENT ON COLUMN SALES."ORDERS"."ID" IS 'the id''s key';
ALTER TABLE SALES."ORDERS" ADD PRIMARY KEY ("ID");
ALTER TABLE SALES."ORDERS" ADD CONSTRAINT fk FOREIGN KEY (CUST_ID) REFERENCES SALES."CUSTOMERS" (ID);
"""),
    ("b.sql", """create table items (
  order_id integer not null,
  line_no int not null,
  amount numeric(12,2)
);
alter table items add constraint pk_items primary key (order_id, line_no);
alter table items add foreign key (order_id) references SALES.ORDERS (ID);
"""),
]

SQL = [
    ("load.sql", """CREATE OR REPLACE PROCEDURE P_LOAD(a int) AS BEGIN
  INSERT INTO dw.fact_sales SELECT * FROM stg.orders o LEFT JOIN stg.items i ON o.id = i.id;
  DELETE FROM stg.tmp;
END;
CREATE OR REPLACE PROCEDURE p_merge AS BEGIN
  MERGE INTO dw.dim_customer d USING (SELECT id FROM stg.customers) s ON (d.id = s.id);
END;
"""),
    ("single.sql", "UPDATE t SET x = 1;"),
    ("none.sql", "SELECT 1 FROM dual;"),
    ("two.sql", "DELETE FROM a; DELETE FROM b; INSERT INTO c VALUES (1);"),
]

FILES = [
    ("A.java", "public class A {}"), ("B.java", "package x.y;\nimport java.util.List;\npublic class B extends A { public static void main(String[] a) { System.out.println(new B()); } }"),
    ("c.py", "import os\ndef f(x):\n    print(x)\n"), ("d.xml", '<?xml version="1.0"?>\n<beans xmlns:a="b"></beans>'), ("blank.sql", "  \n"), ("x.sql", "nothing here"), ("y", "nothing here"),
    *DDL, *SQL, ("pg.sql", "CREATE FUNCTION f() RETURNS VOID AS $$ BEGIN PERFORM g(); RAISE NOTICE 'x'; END; $$ LANGUAGE plpgsql;"),
]

NAMES = ['"RWIS"."T"@L1', "a.b.c", "plain", "[dbo].[t]", "`s`.`t`", " S . T ", "'q'", "x@l", "", None]
PATHS = ["x/SALES/proc", "", "x/y", "/a\\b/Dw/", "//", None]
CODES = ["CREATE PROCEDURE s.pkg.p", "12: CREATE OR REPLACE FUNCTION f(x int)", 'procedure "A b".c is', "create trigger t1", "begin null; end;"]
CLASS_NAMES = ["List", "Logger", "a", "foo", "OrderService", "orderservice", "abc", "Abc", "", None]

GLOSSARIES = [(1, "Sales", None), (2, "Risk", "Technical"), (3, "Empty", None)]
TERMS = [(1, 1, "Order", "A request to buy", "Approved"), (2, 1, "Customer", None, None), (3, 2, "Exposure", "What may be lost", "Draft")]
LINKS = [(1, "BELONGS_TO_DOMAIN", "Commerce"), (1, "HAS_TAG", "core"), (1, "HAS_TAG", "kpi"), (1, "OWNED_BY", "Ann"), (2, "HAS_TAG", "core")]

KEYS = [
    ("nation", "n_regionkey", "region", "r_regionkey", "ddl"), ("supplier", "s_nationkey", "nation", "n_nationkey", "ddl"), ("customer", "c_nationkey", "nation", "n_nationkey", "ddl"),
    ("orders", "o_custkey", "customer", "c_custkey", "ddl"), ("lineitem", "l_orderkey", "orders", "o_orderkey", "ddl"), ("lineitem", "l_partkey", "part", "p_partkey", "user"), ("lineitem", "l_suppkey", "supplier", "s_suppkey", "user"),
]
USES = [("p1", "orders", "FROM"), ("p1", "customer", "FROM"), ("p2", "orders", "WRITES"), ("p2", "part", "FROM"), ("p2", "lineitem", "FROM"), ("p3", "region", "FROM"), ("p1", "part", "FROM")]
DML = [("s1", "sales.orders", "r"), ("s1", "ITEMS", "rw"), ("s2", "x.y@link", "w"), ("s3", "unknown", "r")]

TREE = """{"type":"FILE","startLine":1,"endLine":9,"code":"","children":[
 {"type":"PROCEDURE","name":"P_LOAD","schema":"DW","startLine":1,"endLine":9,"code":"1: CREATE PROCEDURE P_LOAD\\r\\n2: IS v INT;\\r\\n3: BEGIN\\r\\n4: IF v>0 THEN\\r\\n5: INSERT INTO T\\r\\n8: END IF;\\r\\n9: END;","children":[
  {"type":"DECLARE","startLine":2,"endLine":3,"code":"2: v INT;","children":[]},
  {"type":"IF","startLine":4,"endLine":8,"code":"4: IF v>0 THEN\\r\\n5: INSERT INTO T\\r\\n8: END IF;","children":[
   {"type":"INSERT","startLine":5,"endLine":6,"code":"5: INSERT INTO T","children":[]}]}]}]}"""

CLASSES = """{"type":"FILE","startLine":1,"endLine":30,"code":"","children":[
 {"type":"CLASS","name":"OrderService","startLine":1,"endLine":12,"extendsType":"BaseService","code":"1: public class OrderService extends BaseService implements Auditable, Closeable {\\n2:   private OrderStore store = new OrderStore();\\n3:   private List<Customer> customers;\\n4:   private int count;\\n5:   public Invoice bill(Customer who, int n) {\\n6:     store.save(n);\\n7:     customers.clear();\\n8:     return null;\\n9:   }\\n10: }","children":[
  {"type":"FIELD","name":"store","startLine":2,"endLine":2,"code":"2:   private OrderStore store = new OrderStore();","children":[]},
  {"type":"METHOD","name":"bill","startLine":5,"endLine":9,"code":"5:   public Invoice bill(Customer who, int n) {\\n6:     store.save(n);\\n9:   }","children":[]}]},
 {"type":"CLASS","name":"BaseService","startLine":13,"endLine":14,"code":"13: public class BaseService {\\n14: }","children":[]},
 {"type":"CLASS","name":"OrderStore","startLine":15,"endLine":18,"code":"15: class OrderStore {\\n16:   void save(int n) {\\n17:   }\\n18: }","children":[]},
 {"type":"INTERFACE","name":"Auditable","startLine":19,"endLine":20,"code":"19: public interface Auditable {\\n20: }","children":[]},
 {"type":"CLASS","name":"Customer","startLine":21,"endLine":22,"code":"21: class Customer {\\n22: }","children":[]},
 {"type":"CLASS","name":"Invoice","startLine":23,"endLine":24,"code":"23: class Invoice {\\n24: }","children":[]}]}"""
#: Relations that the classes above have: (from, to, type, detail).
RELATIONS = [
    ("OrderService", "BaseService", "EXTENDS", ""), ("OrderService", "Auditable", "IMPLEMENTS", ""), ("OrderService", "OrderStore", "COMPOSITION", "store 1"), ("OrderService", "Customer", "ASSOCIATION", "customers *"),
    ("OrderService", "Invoice", "DEPENDENCY", "return"), ("OrderService", "OrderStore", "CALLS", "save"), ("OrderService", "Customer", "CALLS", "clear"),
]
TEMPORARY = [("t1", "CREATE_TEMP_TABLE", "1: create global temporary table WORK.TMP_A (x int);"), ("t2", "CREATE_TEMP_TABLE", "CREATE TEMP TABLE IF NOT EXISTS b AS SELECT 1"), ("t3", "INSERT", "create temp table c (x int)"), ("t4", "CREATE_TEMP_TABLE", "-- CREATE TEMP TABLE d")]


def literal(x: object) -> str:
    """A value as SQL."""
    return "NULL" if x is None else str(x) if isinstance(x, int | float) else "'" + str(x).replace("'", "''") + "'"


def values(rows: list[tuple], *names: str) -> str:
    """Rows as a SQL subquery with named columns."""
    return "(SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(map(literal, r)) + ")" for r in rows) + f") AS v({', '.join(names)}))"
