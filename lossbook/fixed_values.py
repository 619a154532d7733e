"""Names, bands, codes and constants that results depend on."""

from __future__ import annotations

# Statuses and dates of the loan population.
BAD_STATUSES = ["Chargedoff", "Defaulted"]
GOOD_STATUSES = ["Completed"]
CANCELLED = "Cancelled"

# Feature columns by source.
CREDIT_BUREAU = [
    "CreditScoreRangeLower", "CreditScoreRangeUpper", "CurrentCreditLines", "OpenCreditLines",
    "TotalCreditLinespast7years", "TotalTrades", "TradesNeverDelinquent", "TradesOpenedLast6Months",
    "OpenRevolvingAccounts", "OpenRevolvingMonthlyPayment", "RevolvingCreditBalance",
    "BankcardUtilization", "AvailableBankcardCredit", "CurrentDelinquencies", "AmountDelinquent",
    "DelinquenciesLast7Years", "PublicRecordsLast10Years", "PublicRecordsLast12Months",
    "InquiriesLast6Months", "TotalInquiries", "DebtToIncomeRatio",
]
APPLICATION_NUMERIC = ["Term", "LoanOriginalAmount", "StatedMonthlyIncome", "EmploymentStatusDuration"]
APPLICATION_CATEGORICAL = [
    "IncomeRange", "IncomeVerifiable", "EmploymentStatus", "Occupation",
    "BorrowerState", "ListingCategory", "IsBorrowerHomeowner", "CurrentlyInGroup",
]
PRIOR_HISTORY = [
    "PriorLoans", "PriorPaymentsBilled", "PriorPaymentsOnTime", "PriorPaymentsLateUnderMonth",
    "PriorPaymentsLateOverMonth", "PriorPrincipalBorrowed", "PriorPrincipalOutstanding", "ScoreChange",
]
DERIVED_NUMERIC = [
    "credit_history_months", "credit_score_mid", "loan_to_income", "stated_income_log",
    "is_repeat_borrower", "income_unverified", "dti_capped_flag",
]
DERIVED_CATEGORICAL = ["bankcard_util_bucket"]
ENGINEERED_NUMERIC = [
    "EstMonthlyDebtObligation", "DisposableIncome", "ResidualIncome", "ReferencePTI",
    "TotalUtilization", "OpenToTotalLineRatio", "InquiryVelocity", "RecentDelinquencyShare",
    "OnTimeRate", "OutstandingDebtRatio", "IncomeBand_Mismatch", "Income_Undefined",
]
MODEL_FEATURES = (CREDIT_BUREAU + APPLICATION_NUMERIC + APPLICATION_CATEGORICAL
                  + PRIOR_HISTORY + DERIVED_NUMERIC + DERIVED_CATEGORICAL)
CATEGORICAL_FEATURES = APPLICATION_CATEGORICAL + DERIVED_CATEGORICAL + ["RiskCluster"]
CLUSTER_FEATURES = [
    "loan_to_income", "DebtToIncomeRatio", "BankcardUtilization", "InquiriesLast6Months",
    "DisposableIncome", "TotalUtilization", "OpenToTotalLineRatio", "InquiryVelocity",
]
LABEL_SUPPORT = [
    "LoanStatus", "LoanOriginalAmount", "LP_CustomerPrincipalPayments", "LP_NetPrincipalLoss",
    "LP_GrossPrincipalLoss", "LP_NonPrincipalRecoverypayments",
]
BENCHMARK = ["IncumbentScore", "IncumbentRating"]
TARGET = "is_bad"

# Macro and state feature sets.
MACRO_RAW = ["macro_unemployment", "macro_fedfunds"]
MACRO_TTC = ["macro_unemployment_ttc", "macro_fedfunds_ttc", "macro_unemployment_gap"]
MACRO_ROBUST = ["macro_unemployment_gap", "macro_unemployment_yoy",
                "macro_fedfunds_gap", "macro_fedfunds_yoy"]
STATE_RAW = ["state_unemployment"]
STATE_TTC = ["state_unemployment_ttc", "state_unemployment_gap"]

# Smoothing of macro series.
TTC_WEIGHT = 0.5
EWM_HALFLIFE = 6.0
TRAILING_ROWS = 12

# Annual income bounds of each self-reported band (None = no upper bound).
INCOME_BANDS = {
    "$0": (0, 0),
    "Not employed": (0, 0),
    "$1-24,999": (1, 24_999),
    "$25,000-49,999": (25_000, 49_999),
    "$50,000-74,999": (50_000, 74_999),
    "$75,000-99,999": (75_000, 99_999),
    "$100,000+": (100_000, None),
}

# Bankcard utilization bins, closed on the right.
UTILIZATION_BINS = [(0.30, "<=30%"), (0.50, "30-50%"), (0.75, "50-75%"), (1.00, "75-100%")]
UTILIZATION_TOP = ">100%"
UTILIZATION_MISSING = "Missing"

# Order of the ordinal columns.
ORDINAL_ORDERS = {
    "IncomeRange": ["Not employed", "$0", "$1-24,999", "$25,000-49,999",
                    "$50,000-74,999", "$75,000-99,999", "$100,000+"],
    "bankcard_util_bucket": ["<=30%", "30-50%", "50-75%", "75-100%", ">100%"],
}

# Loan purpose codes.
PURPOSES = {
    0: "Not Available", 1: "Debt Consolidation", 2: "Home Improvement", 3: "Business",
    4: "Personal", 5: "Student", 6: "Auto", 7: "Other", 8: "Baby & Adoption", 9: "Boat",
    10: "Cosmetic", 11: "Engagement Ring", 12: "Green", 13: "Household", 14: "Large Purchases",
    15: "Medical/Dental", 16: "Motorcycle", 17: "RV", 18: "Taxes", 19: "Vacation", 20: "Wedding",
}
# Letters of the incumbent rating codes.
RATINGS = {0: "N/A", 1: "HR", 2: "E", 3: "D", 4: "C", 5: "B", 6: "A", 7: "AA"}

# Declared direction of risk per numeric feature (+1 up, -1 down).
RISK_DIRECTIONS = {
    "DebtToIncomeRatio": 1, "BankcardUtilization": 1, "InquiriesLast6Months": 1,
    "TotalInquiries": 1, "CurrentDelinquencies": 1, "AmountDelinquent": 1,
    "DelinquenciesLast7Years": 1, "PublicRecordsLast10Years": 1, "PublicRecordsLast12Months": 1,
    "RevolvingCreditBalance": 1, "LoanOriginalAmount": 1, "Term": 1, "loan_to_income": 1,
    "EstMonthlyDebtObligation": 1, "ReferencePTI": 1, "TotalUtilization": 1,
    "InquiryVelocity": 1, "RecentDelinquencyShare": 1, "OutstandingDebtRatio": 1,
    "IncomeBand_Mismatch": 1, "Income_Undefined": 1,
    "credit_score_mid": -1, "CreditScoreRangeLower": -1, "CreditScoreRangeUpper": -1,
    "StatedMonthlyIncome": -1, "stated_income_log": -1, "credit_history_months": -1,
    "AvailableBankcardCredit": -1, "DisposableIncome": -1, "ResidualIncome": -1, "OnTimeRate": -1,
}

# Numeric constants.
REFERENCE_APR = 0.15
DTI_CAP = 10.01
UNDEFINED = -1.0
HAZARD_FLOOR = 1e-6
TIMING_BINS = 20
TIMING_PEAK, TIMING_SPREAD = 0.30, 0.18
NEGATIVES_PER_POSITIVE = 20
CALIBRATION_LOAN_SHARE = 0.15
TEST_SHARE = 0.20
CV_FOLDS = 3
APR_CEILING = 0.60
BISECTION_ROUNDS = 60
IV_BANDS = [(0.02, "useless"), (0.1, "weak"), (0.3, "medium"), (0.5, "strong")]
IV_TOP_BAND = "suspicious"
