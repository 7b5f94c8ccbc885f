"""The texts that a match of each pattern of patterns.py must hold, in lower case: of each tuple one.

They spare a text the patterns that can't match in it, and name a pattern in words. Written from the patterns; a test
derives them again and compares.
"""

NEEDED: dict[str, list[tuple[str, ...]]] = {
    '\\bpublic\\s+class\\s+\\w+': [('public',), ('class',)],
    '\\bprivate\\s+class\\s+\\w+': [('private',), ('class',)],
    '\\bclass\\s+\\w+\\s*(extends|implements)': [('class',), ('extends', 'implements')],
    '\\bpublic\\s+interface\\s+\\w+': [('public',), ('interface',)],
    '\\bpackage\\s+[\\w.]+;': [('package',), (';',)],
    '\\bimport\\s+[\\w.]+;': [('import',), (';',)],
    '@(Override|Autowired|Service|Repository|Controller|Component|Entity)': [('@',), ('override', 'autowired', 'service', 'repository', 'controller', 'component', 'entity')],
    '\\bpublic\\s+static\\s+void\\s+main': [('public',), ('static',), ('void',), ('main',)],
    '\\bnew\\s+\\w+\\s*\\(': [('new',), ('(',)],
    'System\\.out\\.print': [('system.out.print',)],
    '^def\\s+\\w+\\s*\\(': [('def',), ('(',)],
    '^class\\s+\\w+\\s*[:\\(]': [('class',)],
    '^import\\s+\\w+': [('import',)],
    '^from\\s+\\w+\\s+import': [('from',), ('import',)],
    'if\\s+__name__\\s*==\\s*["\']__main__["\']': [('if',), ('__name__',), ('==',), ('__main__',)],
    '@\\w+\\s*(\\(|$)': [('@',)],
    'self\\.\\w+': [('self.',)],
    'print\\s*\\(': [('print',), ('(',)],
    'async\\s+def\\s+\\w+': [('async',), ('def',)],
    'await\\s+\\w+': [('await',)],
    '^<\\?xml\\s+': [('<?xml',)],
    '<beans\\s+': [('<beans',)],
    '<configuration\\s*>': [('<configuration',), ('>',)],
    '<project\\s+': [('<project',)],
    '<dependency\\s*>': [('<dependency',), ('>',)],
    '<!DOCTYPE\\s+': [('<!doctype',)],
    'xmlns:': [('xmlns:',)],
    'CREATE\\s+(OR\\s+REPLACE\\s+)?PROCEDURE\\s+\\w+': [('create',), ('procedure',)],
    'CREATE\\s+(OR\\s+REPLACE\\s+)?FUNCTION\\s+\\w+': [('create',), ('function',)],
    'CREATE\\s+(OR\\s+REPLACE\\s+)?PACKAGE\\s+(BODY\\s+)?\\w+': [('create',), ('package',)],
    'CREATE\\s+(OR\\s+REPLACE\\s+)?TRIGGER\\s+\\w+': [('create',), ('trigger',)],
    'CREATE\\s+(OR\\s+REPLACE\\s+)?TYPE\\s+\\w+': [('create',), ('type',)],
    '\\bDECLARE\\b': [('declare',)],
    '\\bBEGIN\\b[\\s\\S]*\\bEND\\s*;': [('begin',), ('end',), (';',)],
    '\\bEXCEPTION\\s+WHEN\\b': [('exception',), ('when',)],
    '\\bDBMS_\\w+\\.\\w+': [('dbms_',), ('.',)],
    '\\bUTL_\\w+\\.\\w+': [('utl_',), ('.',)],
    '\\b(IN|OUT|IN\\s+OUT)\\s+\\w+\\s+(VARCHAR2|NUMBER|DATE|CLOB|BLOB)': [('in', 'out', 'out'), ('varchar2', 'number', 'date', 'clob', 'blob')],
    '%TYPE\\b': [('%type',)],
    '%ROWTYPE\\b': [('%rowtype',)],
    '\\bFOR\\s+\\w+\\s+IN\\s+\\(': [('for',), ('in',), ('(',)],
    '\\bCURSOR\\s+\\w+\\s+IS\\b': [('cursor',), ('is',)],
    '\\bFETCH\\s+\\w+\\s+INTO\\b': [('fetch',), ('into',)],
    '\\bRAISE_APPLICATION_ERROR\\b': [('raise_application_error',)],
    '/\\s*$': [('/',)],
    'CREATE\\s+TABLE\\s+\\w+': [('create',), ('table',)],
    'CREATE\\s+(UNIQUE\\s+)?INDEX\\s+\\w+': [('create',), ('index',)],
    'ALTER\\s+TABLE\\s+\\w+': [('alter',), ('table',)],
    'DROP\\s+TABLE\\s+\\w+': [('drop',), ('table',)],
    'CREATE\\s+SEQUENCE\\s+\\w+': [('create',), ('sequence',)],
    'CREATE\\s+(OR\\s+REPLACE\\s+)?VIEW\\s+\\w+': [('create',), ('view',)],
    'CONSTRAINT\\s+\\w+\\s+(PRIMARY\\s+KEY|FOREIGN\\s+KEY|UNIQUE|CHECK)': [('constraint',), ('primary', 'foreign', 'unique', 'check')],
    'REFERENCES\\s+\\w+\\s*\\(': [('references',), ('(',)],
    '\\b(VARCHAR2|NUMBER|DATE|CLOB|BLOB|RAW)\\s*\\(': [('varchar2', 'number', 'date', 'clob', 'blob', 'raw'), ('(',)],
    'TABLESPACE\\s+\\w+': [('tablespace',)],
    'STORAGE\\s*\\(': [('storage',), ('(',)],
    '\\$\\$\\s*(DECLARE|BEGIN)': [('$$',), ('declare', 'begin')],
    'LANGUAGE\\s+(plpgsql|sql)': [('language',), ('plpgsql', 'sql')],
    'RETURNS\\s+(VOID|SETOF|TABLE|TRIGGER)': [('returns',), ('void', 'setof', 'table', 'trigger')],
    '\\bRAISE\\s+(NOTICE|EXCEPTION|WARNING)': [('raise',), ('notice', 'exception', 'warning')],
    'PERFORM\\s+\\w+': [('perform',)],
    'RETURN\\s+(NEXT|QUERY)': [('return',), ('next', 'query')],
    ':=\\s*': [(':=',)],
    '\\bNEW\\.\\w+': [('new.',)],
    '\\bOLD\\.\\w+': [('old.',)],
    'TG_\\w+': [('tg_',)],
    'CREATE\\s+TABLE\\s+(IF\\s+NOT\\s+EXISTS\\s+)?\\w+': [('create',), ('table',)],
    'CREATE\\s+(UNIQUE\\s+)?INDEX\\s+(CONCURRENTLY\\s+)?\\w+': [('create',), ('index',)],
    '\\b(SERIAL|BIGSERIAL|SMALLSERIAL)\\b': [('serial', 'bigserial', 'smallserial')],
    '\\b(TEXT|JSONB?|UUID|INET|CIDR|MACADDR)\\b': [('text', 'json', 'uuid', 'inet', 'cidr', 'macaddr')],
    'CREATE\\s+EXTENSION': [('create',), ('extension',)],
    'CREATE\\s+SCHEMA': [('create',), ('schema',)],
    'ON\\s+DELETE\\s+(CASCADE|SET\\s+NULL|RESTRICT)': [('on',), ('delete',), ('cascade', 'null', 'restrict')],
    'ON\\s+UPDATE\\s+(CASCADE|SET\\s+NULL|RESTRICT)': [('on',), ('update',), ('cascade', 'null', 'restrict')],
    '\\b(VARCHAR2|NUMBER|CLOB|BLOB|RAW)\\b': [('varchar2', 'number', 'clob', 'blob', 'raw')],
    '\\b(DBMS_|UTL_)\\w+': [('dbms_', 'utl_')],
    'SYSDATE\\b': [('sysdate',)],
    'NVL\\s*\\(': [('nvl',), ('(',)],
    'DECODE\\s*\\(': [('decode',), ('(',)],
    'ROWNUM\\b': [('rownum',)],
    'DUAL\\b': [('dual',)],
    '\\$\\$': [('$$',)],
    'LANGUAGE\\s+plpgsql': [('language',), ('plpgsql',)],
    '\\b(TEXT|JSONB?|UUID|INET|SERIAL)\\b': [('text', 'json', 'uuid', 'inet', 'serial')],
    'RAISE\\s+(NOTICE|EXCEPTION)': [('raise',), ('notice', 'exception')],
    'PERFORM\\s+': [('perform',)],
    'COALESCE\\s*\\(': [('coalesce',), ('(',)],
    'NOW\\(\\)': [('now()',)],
    'CURRENT_TIMESTAMP': [('current_timestamp',)],
    '\\bBEGIN\\b[\\s\\S]*\\bEND\\s*[;/]': [('begin',), ('end',)],
    '\\b(IN|OUT|IN\\s+OUT)\\s+\\w+\\s+(VARCHAR2|NUMBER|DATE)': [('in', 'out', 'out'), ('varchar2', 'number', 'date')],
    '\\bIF\\s+.+\\s+THEN\\b': [('if',), ('then',)],
    '\\bLOOP\\b': [('loop',)],
    '\\bFETCH\\b': [('fetch',)],
    ':=': [(':=',)],
    'CONSTRAINT\\s+\\w+\\s+(PRIMARY|FOREIGN|UNIQUE|CHECK)': [('constraint',), ('primary', 'foreign', 'unique', 'check')],
    'PRIMARY\\s+KEY\\s*\\(': [('primary',), ('key',), ('(',)],
    'FOREIGN\\s+KEY\\s*\\(': [('foreign',), ('key',), ('(',)],
}
