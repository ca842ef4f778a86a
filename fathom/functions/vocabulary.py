"""Word lists, weights and limits that rankings must share to give the same results."""

from __future__ import annotations


def words(text: str) -> tuple[str, ...]:
    return tuple(text.split())


# Names and words of validation.
VALIDATION_PREFIXES = words("validate check ensure guard can allow authorize")
INVESTIGATION_VALIDATION_PREFIXES = words("require enforce")
VALIDATION_WORDS = words("allow authorize can check deny error exception forbidden guard invalid raise reject unauthorized validate validation validator validators")

# Words of a failure's text.
BEHAVIORAL_WORDS = words("archived cannot deny denied expired forbidden invalid limit reject rejected should threshold transition unauthorized validation")
OPERATION_WORDS = words("accept accepted allow allowed archive archived approve approved attach attached authorize balance cancel cancelled charge close closed credit create created debit delete deleted deposit detach detached disable disabled enable enabled exclude excluded filter filtered grant granted include included list lock locked mark marked move moved open opened query rank record recorded reject rejected remove removed reserve reserved revoke revoked search ship shipped sort start started stop stopped transfer transferred unlock unlocked update updated validate withdraw withdrawn")
DOMAIN_STOP_WORDS = words("and assert class did does error expected failed false for from got is not none pytest raise raises should test tests the true with")
NORMAL_FORMS = dict(pair.split(":") for pair in words("accepted:accept allowed:allow approved:approve attached:attach balances:balance closed:close created:create deleted:delete denied:deny detached:detach disabled:disable enabled:enable excluded:exclude filters:filter filtered:filter granted:grant included:include locked:lock marked:mark moves:move moved:move opened:open records:record recorded:record rejected:reject released:release removed:remove revoked:revoke reserves:reserve reserved:reserve ships:ship shipped:ship shipping:ship started:start stopped:stop transferred:transfer unlocked:unlock updated:update withdrawn:withdraw"))
MEANINGLESS_FAILURE_WORDS = words("assert assertion error failed failure false none test tests true")
TEST_INFRASTRUCTURE = words("capfd caplog capsys fixture monkeypatch mock tmp_path unittest")
NOISY_SYMBOLS = words("assert repr str int float bool list dict set tuple len range print")

# Roles and logic, as diagnosis sees them.
BUSINESS_ROLES = words("business domain engine interactor manager policy policies processor rule rules search service usecase workflow")
ROUTE_ROLES = words("api controller controllers endpoint handler route routes view")
FILTERING_WORDS = words("criteria filter list match query rank rating result results search sort")
STATE_UPDATE_WORDS = words("add append apply assign cancel change charge clear complete credit debit delete extend insert move record remove reserve save set ship submit transfer update")
MUTATORS = STATE_UPDATE_WORDS
DATA_ACCESS_FOLDERS = words("dao data database db queries repositories repository storage stores")
DATA_ACCESS_PARENTS = words("repository store storage dao")
CRUD_PREFIXES = words("add create delete fetch find get insert list load read record remove save select update write")

# The same, as an investigation sees them.
INVESTIGATION_STOP_WORDS = words("a an and are as at be but by does for from i in into is it its not of on or the to when with")
INVESTIGATION_ROLES = words("business domain engine flow manager policy processor search service workflow")
INVESTIGATION_FILTERING = words("criteria filter filtered genre list match query rank rating result results search sort year")
INVESTIGATION_STATE = words("add amount balance cancel change credit debit increase move quantity record reserve save ship state status stock transfer update")
STORAGE_QUERY_WORDS = words("database db repository storage store persistence")
INVESTIGATION_DATA_ACCESS = words("dao database db find get list load repository save storage store")
GENERIC_DATA_ACCESS_NAMES = words("add create delete find get list load read record save write")
IGNORED_CALL_HEADS = words("repository repo storage store database db self cls")
INVESTIGATION_INTENT = "likely source code, business logic, validation, state update, filtering, related dependencies"

# Operations that undo one another, and words of states they change.
PAIRS = tuple(tuple(p.split("/")) for p in words("add/remove approve/reject attach/detach close/open credit/debit deposit/withdraw disable/enable exclude/include grant/revoke lock/unlock reserve/release start/stop"))
COUNTERPARTS = {a: b for a, b in PAIRS} | {b: a for a, b in PAIRS}
PAIRED_WORDS = tuple(sorted(COUNTERPARTS))
STATE_CONTEXT_WORDS = words("activity amount balance count counterpart destination inventory item money movement order quantity record source state status stock target total")
STATE_CHANGE_WORDS = words("change changed move moved transfer transferred update updated")

# Words by which a query asks for tests or for the index itself.
TEST_QUERY_WORDS = words("test tests testing pytest")
INFRASTRUCTURE_QUERY_WORDS = words("index indexing indexed embed embedding embeddings vector vectors chunk chunks metadata store")

# Directories a scan leaves out, besides any that begins with .pytest_tmp.
EXCLUDED_DIRECTORIES = words(".git .venv .cache .pytest_cache __pycache__ node_modules dist build")

# Weights of the failure score.
FAILURE_WEIGHTS = {
    "test_chunk_penalty": -0.35, "source_chunk_boost": 0.10, "message_symbol_match": 0.60, "traceback_symbol_match": 0.35, "same_file_source_hint": 0.25, "same_directory_source_hint": 0.15,
    "contains_expected_exception": 1.50, "expected_exception_definition": 3.00, "business_operation": 0.75, "state_update_logic": 0.55, "paired_state_operation": 0.55, "possible_missing_counterpart_operation": 0.40,
    "filtering_logic": 0.65, "generic_crud_or_data_access_penalty": -0.90, "route_or_controller_passthrough_penalty": -0.35, "constructor_or_init_penalty": -0.35, "single_paired_operation_penalty": -0.45, "unrelated_exception_class_penalty": -0.35,
}
OVERLAP_WEIGHTS = {"exception_symbol_overlap": (0.20, 0.80), "behavioral_keyword_overlap": (0.12, 0.48), "operation_keyword_overlap": (0.10, 0.40), "domain_keyword_overlap": (0.05, 0.25)}
