"""Column types of the register tables, as Spark DDL."""

_MONEY = "decimal(18,2)"

# The risk flags of a counterparty check, in output order.
CHECK_FLAGS = [
    "net_profit", "net_assets", "debt", "rev_loss", "tax_debt", "fr_acc", "bad_sup", "inv_add", "cur_status", "age",
    "ben_chg", "gov_chg", "dsq", "abs_rep", "inv_fnd", "inv_gov", "bl", "bp", "arb_claim", "arb_def", "staff_number",
    "rkn_license",
]

SCHEMAS = {
    # company register
    "accounting_report": "accounting_report_id bigint, bk_hash string, spark_id bigint, balance_type string, "
    "accounting_period_code string, form_name string, financial_indicator_code string, valid_from timestamp, "
    f"section_name string, line_code string, line_name string, line_value {_MONEY}, deleted_flag boolean",
    "accounting_report_actual": "accounting_report_id bigint, bk_hash string, spark_id bigint, balance_type string, "
    "accounting_period_code string, form_name string, financial_indicator_code string, section_name string, "
    f"line_code string, line_name string, line_value {_MONEY}",
    "dct_accounting_period": "code string, period_name string",
    "cd_inn": "spark_id bigint",
    "legal_entity_actual": "spark_id bigint, inn string, ogrn string, kpp string, okopf_code string, "
    "full_name_rus string",
    "state_contract_participant_actual": "spark_id bigint, contract_code string, contract_participant_code string, "
    "state_contract_role_code string",
    "dct_contract_participant_actual": "code string, participant_spark_id bigint, participant_inn_code string, "
    "participant_ogrn_code string, participant_name string",
    "state_contract_actual": f"code string, contract_date date, currency_code string, contract_sum {_MONEY}, "
    "federallaw_code string, contract_subject_txt string",
    "counterparty_checks": "spark_id bigint, inn string, ogrn string, kpp string, okfs_code string, okfs_name string, "
    "okopf_name string, full_name_rus string, short_name_rus string, status_name string, "
    f"first_registration_date date, revenue {_MONEY}, net_profit {_MONEY}, net_assets {_MONEY}, "
    + ", ".join(f"{f}_flag string" for f in CHECK_FLAGS)
    + f", report_year int, check_result string, lim_calc {_MONEY}",
    "include_lists": "list_name string, is_negative boolean, status_name string, full_name_rus string, inn string, "
    "ogrn string, kpp string",
    # property deals
    "deal_actual": "bkh string, realty_bkh string, registration_date date, cancel_date date, region_code string, "
    f"deal_num string, subject_description string, deal_condition_txt string, deal_price_amt {_MONEY}, "
    "deal_price_txt string",
    "cadastral_doc_actual": "bkh string, reference_bkh string, cadastral_doc_type_bkh string, "
    "cadastral_doc_addition_txt string, cadastral_doc_num string",
    "dct_cadastral_doc_type_actual": "bkh string, cadastral_doc_type_code string",
    "realty_actual": "bkh string, cadastral_num string, realty_type_bkh string, region_code string, "
    f"room_number_txt string, room_name string, floor_number_txt string, plan_number_txt string, room_area_amt {_MONEY}",
    "share_subject_description_actual": "bkh string, reference_bkh string, ods_description string, "
    "transfer_deadline_txt string",
    "realty_address_actual": "realty_bkh string, realty_region_bkh string",
    "dct_region_actual": "bkh string",
    # property adverts
    "advert": "advert_id bigint, bkh string, src_cian_id bigint, src_realty_id bigint, realty_agency_bkh string, "
    "status_bkh string, advert_category_bkh string, housing_complex_block_code string, housing_complex_name string, "
    f"price_amt {_MONEY}, price_sqm_amt {_MONEY}, total_area_amt {_MONEY}, currency_name string, room_cnt int, "
    "realty_latitude double, realty_longitude double, valid_from timestamp, deleted_flag boolean",
    "advert_actual": "bkh string, src_cian_id bigint, src_realty_id bigint, realty_agency_bkh string, "
    "status_bkh string, advert_category_bkh string, building_type_bkh string, create_date date, "
    f"price_amt {_MONEY}, total_area_amt {_MONEY}, price_sqm_amt {_MONEY}, deposit_amt {_MONEY}, "
    "advert_url_txt string, subway_minute_amt int, prepay_month_cnt int, user_address_txt string",
    "advert_statistic": "advert_bkh string, valid_from timestamp, src_update_date timestamp, deleted_flag boolean",
    "advert_statistic_actual": "advert_bkh string, src_update_date timestamp, src_upload_date timestamp, "
    "view_cnt bigint",
    "dct_realty_agency": "bkh string, realty_agency_name string, deleted_flag boolean",
    "dct_realty_agency_actual": "bkh string, realty_agency_name string",
    "dct_status": "bkh string, status_name string, status_code int",
    "dct_status_actual": "bkh string, status_name string, status_code int",
    "address": "src_realty_id bigint, user_address_txt string, deleted_flag boolean",
    "address_actual": "src_realty_id bigint, region_name string, settlement_name string, user_address_txt string",
    "dct_advert_category_actual": "bkh string, advert_category_code string, advert_category_name string",
    "dct_housing_complex_block_actual": "housing_complex_block_code string, building_class_bkh string",
    "dct_building_class_actual": "bkh string, building_class_type string, building_class_name string",
    "dct_building_type_actual": "bkh string, building_type_name string",
    # construction objects and documents
    "object_actual": "bkh string, src_object_id bigint, object_id bigint, title_name string, full_address_txt string",
    "object_land_actual": "object_bkh string, project_declaration_bkh string, cadastral_num string",
    "project_declaration_prepared_actual": "project_declaration_prepared_bkh string",
    "project_declaration_object_actual": "project_declaration_bkh string, object_bkh string, "
    f"total_area_amt {_MONEY}, living_area_amt {_MONEY}, floor_max_cnt int, floor_min_cnt int",
    "object_address_actual": "object_bkh string, house_num string",
    "document_actual": "bkh string, document_id bigint, document_type_bkh string, document_num string, "
    "document_issue_date date",
    "dct_document_type_actual": "bkh string, document_type_code string",
    "file_actual": "bkh string, file_id bigint, file_type_bkh string, file_original_name string, file_url_txt string",
    "dct_file_type_actual": "bkh string, file_type_code string",
    "rel_document_file_actual": "document_bkh string, file_bkh string",
    "rel_document_object_actual": "document_bkh string, src_object_id bigint",
    # request log
    "request_log": "event_time timestamp, query_name string, request_type string, response_time_ms bigint, "
    "response_length bigint, exception string",
}
