"""Table contracts: Spark schemas, text widths, and the certificate fields."""

from pyspark.sql import types as T

from gable import fixed

TEXT, LONG, BOOL, TIME = T.StringType(), T.LongType(), T.BooleanType(), T.TimestampType()


def _schema(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


POSTCODES = _schema(
    postcode=TEXT, street=TEXT, town=TEXT, district=TEXT, county=TEXT,
    outcode=TEXT, area=TEXT, sector=TEXT,
)
HOUSES = _schema(houseid=TEXT, paon=TEXT, saon=TEXT, postcode=TEXT, type=TEXT)
SALES = _schema(tui=TEXT, price=LONG, date=TIME, new=BOOL, freehold=BOOL, ppd_cat=TEXT, houseid=TEXT)
UPRN_LOOKUP = _schema(houseid=TEXT, uprn=LONG)
USAGE = _schema(id=TEXT, user_id=TEXT, api_route=TEXT, tokens=LONG, timestamp=TIME, ledger_id=TEXT)
LEDGERS = _schema(
    id=TEXT, user_id=TEXT, total_tokens=LONG, period_start=TIME, period_end=TIME,
    timestamp=TIME, stripe_event_id=TEXT, aggregation_event_id=TEXT,
)
RUN_ITEMS = _schema(
    id=TEXT, user_id=TEXT, tokens=LONG, timestamp=TIME, ledger_id=TEXT, day=T.DateType(), run_ledger=TEXT
)
AGGREGATION_EVENTS = _schema(id=TEXT, run_time=LONG, timestamp=TIME)
LOAD_STATE = _schema(
    last_ppd_update=TIME, last_ppd_file=TEXT, last_epc_update=TIME, last_epc_file=TEXT,
    last_linking_run=TIME, last_init_data=TIME,
)
SALE_FILE = T.StructType(
    [T.StructField(c, LONG if c == "price" else TEXT) for c in fixed.SALE_FILE_COLUMNS]
)

KEYS = {"postcodes": "postcode", "houses": "houseid", "sales": "tui", "certificates": "lmk_key"}

# Widest text each column may hold.
WIDTHS = {
    "postcodes": {
        "postcode": 15, "street": 70, "town": 50, "district": 50, "county": 50,
        "outcode": 4, "area": 2, "sector": 6,
    },
    "houses": {"houseid": 150, "paon": 150, "saon": 150, "postcode": 15},
    "sales": {"tui": 36, "houseid": 150},
}

# Certificate fields in file order, as (field, type). The header of
# a field is its name in capitals. `text` blanks become null, `rating` keeps A-G,
# numbers and dates that do not parse become null.
CERTIFICATE_FIELDS = (
    ("lmk_key", "key"),
    ("address1", "text"),
    ("address2", "text"),
    ("address3", "text"),
    ("postcode", "text"),
    ("building_reference_number", "text"),
    ("current_energy_rating", "rating"),
    ("potential_energy_rating", "rating"),
    ("current_energy_efficiency", "int"),
    ("potential_energy_efficiency", "int"),
    ("property_type", "text"),
    ("built_form", "text"),
    ("inspection_date", "date"),
    ("local_authority", "text"),
    ("constituency", "text"),
    ("county", "text"),
    ("lodgement_date", "date"),
    ("transaction_type", "text"),
    ("environment_impact_current", "int"),
    ("environment_impact_potential", "int"),
    ("energy_consumption_current", "decimal(10,2)"),
    ("energy_consumption_potential", "decimal(10,2)"),
    ("co2_emissions_current", "decimal(10,3)"),
    ("co2_emiss_curr_per_floor_area", "decimal(10,3)"),
    ("co2_emissions_potential", "decimal(10,3)"),
    ("lighting_cost_current", "decimal(12,2)"),
    ("lighting_cost_potential", "decimal(12,2)"),
    ("heating_cost_current", "decimal(12,2)"),
    ("heating_cost_potential", "decimal(12,2)"),
    ("hot_water_cost_current", "decimal(12,2)"),
    ("hot_water_cost_potential", "decimal(12,2)"),
    ("total_floor_area", "decimal(10,2)"),
    ("energy_tariff", "text"),
    ("mains_gas_flag", "text"),
    ("floor_level", "text"),
    ("flat_top_storey", "text"),
    ("flat_storey_count", "int"),
    ("main_heating_controls", "text"),
    ("multi_glaze_proportion", "decimal(5,2)"),
    ("glazed_type", "text"),
    ("glazed_area", "text"),
    ("extension_count", "decimal(4,1)"),
    ("number_habitable_rooms", "decimal(5,1)"),
    ("number_heated_rooms", "decimal(5,1)"),
    ("low_energy_lighting", "int"),
    ("number_open_fireplaces", "int"),
    ("hotwater_description", "text"),
    ("hot_water_energy_eff", "text"),
    ("hot_water_env_eff", "text"),
    ("floor_description", "text"),
    ("floor_energy_eff", "text"),
    ("floor_env_eff", "text"),
    ("windows_description", "text"),
    ("windows_energy_eff", "text"),
    ("windows_env_eff", "text"),
    ("walls_description", "text"),
    ("walls_energy_eff", "text"),
    ("walls_env_eff", "text"),
    ("secondheat_description", "text"),
    ("sheating_energy_eff", "text"),
    ("sheating_env_eff", "text"),
    ("roof_description", "text"),
    ("roof_energy_eff", "text"),
    ("roof_env_eff", "text"),
    ("mainheat_description", "text"),
    ("mainheat_energy_eff", "text"),
    ("mainheat_env_eff", "text"),
    ("mainheatcont_description", "text"),
    ("mainheatc_energy_eff", "text"),
    ("mainheatc_env_eff", "text"),
    ("lighting_description", "text"),
    ("lighting_energy_eff", "text"),
    ("lighting_env_eff", "text"),
    ("main_fuel", "text"),
    ("wind_turbine_count", "decimal(4,1)"),
    ("heat_loss_corridor", "text"),
    ("unheated_corridor_length", "decimal(10,2)"),
    ("floor_height", "decimal(6,2)"),
    ("photo_supply", "decimal(5,2)"),
    ("solar_water_heating_flag", "text"),
    ("mechanical_ventilation", "text"),
    ("address", "text"),
    ("local_authority_label", "text"),
    ("constituency_label", "text"),
    ("posttown", "text"),
    ("construction_age_band", "text"),
    ("lodgement_datetime", "datetime"),
    ("tenure", "text"),
    ("fixed_lighting_outlets_count", "decimal(6,1)"),
    ("low_energy_fixed_light_count", "decimal(6,1)"),
    ("uprn", "bigint"),
    ("uprn_source", "text"),
    ("report_type", "int"),
)

# Certificate fields stored under another name.
CERTIFICATE_RENAMES = {
    "local_authority_label": "local_authority_name",
    "constituency_label": "constituency_name",
    "posttown": "post_town",
}

CERTIFICATE_HEADERS = tuple(field.upper() for field, _ in CERTIFICATE_FIELDS)
