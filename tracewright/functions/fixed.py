"""They must be these for right results."""

# Statement kinds of stored procedures.
PROCEDURE_TYPES = ("PROCEDURE", "FUNCTION", "CREATE_PROCEDURE_BODY", "TRIGGER", "BEGIN")
NOT_ANALYSED = ("CREATE_PROCEDURE_BODY", "FILE", "PROCEDURE", "FUNCTION", "DECLARE", "TRIGGER", "SPEC")
NOT_FOLLOWED = ("FUNCTION", "PROCEDURE", "PACKAGE_VARIABLE", "TRIGGER")
DML_TYPES = ("SELECT", "INSERT", "UPDATE", "DELETE", "MERGE", "EXECUTE_IMMEDIATE", "FETCH", "CREATE_TEMP_TABLE", "CTE", "OPEN_CURSOR", "CURSOR_VARIABLE")

# Kinds of object-oriented code.
CLASS_TYPES = ("CLASS", "INTERFACE", "ENUM")
CLASS_NOT_ANALYSED = ("FILE", "PACKAGE", "IMPORT", "CLASS", "INTERFACE", "ENUM", "FIELD")
METHOD_TYPES = ("METHOD", "CONSTRUCTOR")

# Class names that are no domain classes.
BUILTIN_TYPES = (
    "int", "long", "double", "float", "boolean", "char", "byte", "short", "void",
    "Integer", "Long", "Double", "Float", "Boolean", "Character", "Byte", "Short",
    "String", "Object", "Class", "Enum", "System", "Math", "Runtime",
    "List", "ArrayList", "LinkedList", "Set", "HashSet", "TreeSet", "LinkedHashSet",
    "Map", "HashMap", "TreeMap", "LinkedHashMap", "ConcurrentHashMap",
    "Collection", "Collections", "Arrays", "Iterator", "Iterable",
    "Queue", "Deque", "Stack", "Vector", "PriorityQueue",
    "Optional", "Stream", "Collectors", "Comparator", "Comparable",
    "Date", "Calendar", "LocalDate", "LocalTime", "LocalDateTime", "Instant",
    "UUID", "Random", "Scanner", "Pattern", "Matcher",
    "Exception", "RuntimeException", "Throwable", "Error",
    "IOException", "SQLException", "NullPointerException", "IllegalArgumentException",
    "File", "Path", "Files", "InputStream", "OutputStream", "Reader", "Writer",
    "BufferedReader", "BufferedWriter", "PrintWriter", "FileReader", "FileWriter",
    "StringBuilder", "StringBuffer", "BigDecimal", "BigInteger",
    "Logger", "Log", "LogFactory",
)
UTILITY_CLASSES = (
    "Debug", "Logger", "Log", "LogFactory", "LogManager",
    "Utils", "Utility", "Utilities", "Helper", "Helpers",
    "Constants", "Config", "Configuration", "Settings",
    "Validator", "Validation", "Formatter", "Converter",
    "StringUtils", "DateUtils", "NumberUtils", "CollectionUtils",
    "Assert", "Assertions", "Preconditions", "Check",
)

# Families of column types: a type belongs to one if it contains one of the words.
NUMERIC_TYPES = ("int", "integer", "bigint", "smallint", "numeric", "decimal", "float", "double", "real", "number")
STRING_TYPES = ("varchar", "char", "text", "string", "nvarchar", "nchar", "varchar2")
DATE_TYPES = ("date", "datetime", "timestamp", "time")

# Names that are no tables in SQL.
SYSTEM_NAMES = ("dual", "sysdate", "systimestamp", "user", "rownum", "all_tables", "user_tables", "dba_tables", "information_schema", "pg_catalog")
