"""The weighted patterns of the file type detector. They must be these for right results."""

JAVA = (
    (r"\bpublic\s+class\s+\w+", 0.9), (r"\bprivate\s+class\s+\w+", 0.9), (r"\bclass\s+\w+\s*(extends|implements)", 0.9),
    (r"\bpublic\s+interface\s+\w+", 0.9), (r"\bpackage\s+[\w.]+;", 0.8), (r"\bimport\s+[\w.]+;", 0.7),
    (r"@(Override|Autowired|Service|Repository|Controller|Component|Entity)", 0.85),
    (r"\bpublic\s+static\s+void\s+main", 0.95), (r"\bnew\s+\w+\s*\(", 0.6), (r"System\.out\.print", 0.7),
)
ORACLE_SP = (
    (r"CREATE\s+(OR\s+REPLACE\s+)?PROCEDURE\s+\w+", 0.95), (r"CREATE\s+(OR\s+REPLACE\s+)?FUNCTION\s+\w+", 0.95),
    (r"CREATE\s+(OR\s+REPLACE\s+)?PACKAGE\s+(BODY\s+)?\w+", 0.95), (r"CREATE\s+(OR\s+REPLACE\s+)?TRIGGER\s+\w+", 0.9),
    (r"CREATE\s+(OR\s+REPLACE\s+)?TYPE\s+\w+", 0.85), (r"\bDECLARE\b", 0.6), (r"\bBEGIN\b[\s\S]*\bEND\s*;", 0.7),
    (r"\bEXCEPTION\s+WHEN\b", 0.8), (r"\bDBMS_\w+\.\w+", 0.85), (r"\bUTL_\w+\.\w+", 0.8),
    (r"\b(IN|OUT|IN\s+OUT)\s+\w+\s+(VARCHAR2|NUMBER|DATE|CLOB|BLOB)", 0.85), (r"%TYPE\b", 0.8), (r"%ROWTYPE\b", 0.8),
    (r"\bFOR\s+\w+\s+IN\s+\(", 0.7), (r"\bCURSOR\s+\w+\s+IS\b", 0.85), (r"\bFETCH\s+\w+\s+INTO\b", 0.8),
    (r"\bRAISE_APPLICATION_ERROR\b", 0.9), (r"/\s*$", 0.5),
)
ORACLE_DDL = (
    (r"CREATE\s+TABLE\s+\w+", 0.9), (r"CREATE\s+(UNIQUE\s+)?INDEX\s+\w+", 0.85), (r"ALTER\s+TABLE\s+\w+", 0.85),
    (r"DROP\s+TABLE\s+\w+", 0.8), (r"CREATE\s+SEQUENCE\s+\w+", 0.85), (r"CREATE\s+(OR\s+REPLACE\s+)?VIEW\s+\w+", 0.85),
    (r"CONSTRAINT\s+\w+\s+(PRIMARY\s+KEY|FOREIGN\s+KEY|UNIQUE|CHECK)", 0.85), (r"REFERENCES\s+\w+\s*\(", 0.8),
    (r"\b(VARCHAR2|NUMBER|DATE|CLOB|BLOB|RAW)\s*\(", 0.7), (r"TABLESPACE\s+\w+", 0.75), (r"STORAGE\s*\(", 0.7),
)
POSTGRESQL_SP = (
    (r"CREATE\s+(OR\s+REPLACE\s+)?FUNCTION\s+\w+", 0.8), (r"CREATE\s+(OR\s+REPLACE\s+)?PROCEDURE\s+\w+", 0.85),
    (r"\$\$\s*(DECLARE|BEGIN)", 0.9), (r"LANGUAGE\s+(plpgsql|sql)", 0.9), (r"RETURNS\s+(VOID|SETOF|TABLE|TRIGGER)", 0.85),
    (r"\bRAISE\s+(NOTICE|EXCEPTION|WARNING)", 0.9), (r"PERFORM\s+\w+", 0.85), (r"RETURN\s+(NEXT|QUERY)", 0.85),
    (r":=\s*", 0.6), (r"\bNEW\.\w+", 0.8), (r"\bOLD\.\w+", 0.8), (r"TG_\w+", 0.85),
)
POSTGRESQL_DDL = (
    (r"CREATE\s+TABLE\s+(IF\s+NOT\s+EXISTS\s+)?\w+", 0.85), (r"CREATE\s+(UNIQUE\s+)?INDEX\s+(CONCURRENTLY\s+)?\w+", 0.8),
    (r"ALTER\s+TABLE\s+\w+", 0.8), (r"\b(SERIAL|BIGSERIAL|SMALLSERIAL)\b", 0.85),
    (r"\b(TEXT|JSONB?|UUID|INET|CIDR|MACADDR)\b", 0.75), (r"CREATE\s+EXTENSION", 0.9), (r"CREATE\s+SCHEMA", 0.85),
    (r"ON\s+DELETE\s+(CASCADE|SET\s+NULL|RESTRICT)", 0.7), (r"ON\s+UPDATE\s+(CASCADE|SET\s+NULL|RESTRICT)", 0.7),
)
PYTHON = (
    (r"^def\s+\w+\s*\(", 0.8), (r"^class\s+\w+\s*[:\(]", 0.85), (r"^import\s+\w+", 0.7), (r"^from\s+\w+\s+import", 0.75),
    (r"""if\s+__name__\s*==\s*["']__main__["']""", 0.9), (r"@\w+\s*(\(|$)", 0.7), (r"self\.\w+", 0.75), (r"print\s*\(", 0.5),
    (r"async\s+def\s+\w+", 0.85), (r"await\s+\w+", 0.8),
)
XML = (
    (r"^<\?xml\s+", 0.95), (r"<beans\s+", 0.9), (r"<configuration\s*>", 0.85), (r"<project\s+", 0.85),
    (r"<dependency\s*>", 0.8), (r"<!DOCTYPE\s+", 0.85), (r"xmlns:", 0.7),
)

#: By type, in the order that decides ties. Only XML minds the case.
TYPES = {"java": JAVA, "python": PYTHON, "xml": XML, "oracle_sp": ORACLE_SP, "oracle_ddl": ORACLE_DDL, "postgresql_sp": POSTGRESQL_SP, "postgresql_ddl": POSTGRESQL_DDL}

# Which dialect: matched ones are counted.
ORACLE_SIGNS = (r"\b(VARCHAR2|NUMBER|CLOB|BLOB|RAW)\b", r"\b(DBMS_|UTL_)\w+", r"%TYPE\b", r"%ROWTYPE\b", r"/\s*$", r"SYSDATE\b", r"NVL\s*\(", r"DECODE\s*\(", r"ROWNUM\b", r"DUAL\b")
POSTGRESQL_SIGNS = (r"\$\$", r"LANGUAGE\s+plpgsql", r"\b(TEXT|JSONB?|UUID|INET|SERIAL)\b", r"RAISE\s+(NOTICE|EXCEPTION)", r"PERFORM\s+", r"RETURN\s+(NEXT|QUERY)", r"COALESCE\s*\(", r"NOW\(\)", r"CURRENT_TIMESTAMP")
# Procedures or definitions.
BLOCK = r"\bBEGIN\b[\s\S]*\bEND\s*[;/]"
SP_SIGNS = (BLOCK, r"\bDECLARE\b", r"\bEXCEPTION\s+WHEN\b", r"\b(IN|OUT|IN\s+OUT)\s+\w+\s+(VARCHAR2|NUMBER|DATE)", r"\bCURSOR\s+\w+\s+IS\b", r"\bFOR\s+\w+\s+IN\s+\(", r"\bIF\s+.+\s+THEN\b", r"\bLOOP\b", r"\bFETCH\b", r":=")
DDL_SIGNS = (r"CREATE\s+TABLE\s+\w+", r"ALTER\s+TABLE\s+\w+", r"DROP\s+TABLE\s+\w+", r"CREATE\s+(UNIQUE\s+)?INDEX\s+\w+", r"CREATE\s+SEQUENCE\s+\w+", r"CONSTRAINT\s+\w+\s+(PRIMARY|FOREIGN|UNIQUE|CHECK)", r"REFERENCES\s+\w+\s*\(", r"PRIMARY\s+KEY\s*\(", r"FOREIGN\s+KEY\s*\(")

#: File extensions that count as SQL for the bonus, and for falling back to generic SQL.
SQL_BONUS = ("sql", "pls", "pck", "pkb", "pks", "trg", "fnc", "prc", "ddl")
SQL_GENERIC = ("sql", "pls", "pck", "pkb", "pks", "trg", "fnc", "prc")
#: Strategy and target by type.
SUGGESTED = {
    "java": ("framework", "java"), "python": ("framework", "python"), "xml": ("framework", "java"), "oracle_sp": ("dbms", "oracle"), "oracle_ddl": ("dbms", "oracle"),
    "postgresql_sp": ("dbms", "postgresql"), "postgresql_ddl": ("dbms", "postgresql"), "sql_generic": ("dbms", "oracle"), "unknown": ("framework", "java"),
}
