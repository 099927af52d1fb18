"""Table layouts of a code corpus.  ``app_id`` tells the applications of one corpus apart.

Class keys are dotted binary names (``p.Outer$Inner``); a method key is its owner, name and parameter
descriptors; a field key its owner and name.  Offsets into text count code points.
"""

SYM = "struct<kind:string,owner:string,name:string,params:array<string>>"

APP = "app_id string, input_name string, load_order int, format string"
CLASS = (
    "app_id string, cls string, flags int, super string, interfaces array<string>, "
    "source_file string, input_file string, load_order int, ord int"
)
FIELD = "app_id string, cls string, name string, type string, flags int, const string, ord int"
METHOD = (
    "app_id string, method_key string, cls string, name string, params array<string>, ret string, "
    "flags int, registers int, has_code boolean, has_handlers boolean, error string, ord int"
)
INSN = (
    "app_id string, method_key string, off int, op string, regs array<int>, literal bigint, "
    "target int, ref string"
)
TRY_RANGE = (
    "app_id string, method_key string, start_off int, end_off int, "
    "handlers array<struct<type:string,off:int>>"
)
LOCAL_VAR = (
    "app_id string, method_key string, reg int, name string, type string, start_off int, "
    "end_off int, is_param boolean"
)
ANNOTATION = (
    "app_id string, owner_key string, type string, visibility string, "
    "values map<string,struct<kind:string,value:string>>"
)
UNIT = "app_id string, unit string, code string, error_count int"
ANNOT = f"app_id string, unit string, off int, kind string, sym {SYM}"
EDGE = "method_key string, src int, dst int, exceptional boolean"
USAGE = f"app_id string, target {SYM}, from_unit string, from_member {SYM}, off int, line int"
RESOURCE = (
    "app_id string, id int, package string, type string, name string, config string, vtype int, "
    "vdata int, bag array<struct<name_ref:int,vtype:int,vdata:int>>, parent_ref int, ord int"
)
ENTRY = "archive string, pos int, name string, method int, csize bigint, usize bigint"
SIGNALS = "struct<no_error:boolean,recompiles:boolean,exec:boolean>"
SCORE = f"sample string, category string, failed boolean, score {SIGNALS}"
EDIT_LOG = "app_id string, seq bigint, sym string, text string"
