"""Vocabularies, lookup tables, the playbook and the texts the results depend on.

Everything in this module is data. The order matters where a list is used to break ties.
"""

# --- fixed values: event vocabulary ---------------------------------------------------------
EVENTS = [
    "page_view", "product_view", "size_chart_open", "spec_open", "review_open", "search", "search_zero_results",
    "rec_impression", "rec_click", "add_to_cart", "remove_from_cart", "cart_view", "checkout_start", "pincode_check",
    "delivery_info_view", "total_shown", "coupon_apply", "coupon_failed", "login_wall", "otp_sent", "otp_resend",
    "otp_failed", "payment_attempt", "payment_failed", "payment_success", "order_placed", "tracking_view",
    "rage_click", "dead_click", "js_error", "slow_load", "size_unavailable_click", "notify_me", "exit",
    "login_success", "coupon_applied", "chat_open", "help_view", "return_initiated", "order_cancelled",
]

# --- fixed values: funnel -------------------------------------------------------------------
STEPS = ["browse", "product", "cart", "checkout", "payment", "order", "post_purchase"]
SHOPPING_STEPS = STEPS[:6]
PAGE_STEP = {
    "home": "browse", "search": "browse", "category": "browse", "product": "product", "cart": "cart",
    "checkout_login": "checkout", "checkout_address": "checkout", "checkout_delivery": "checkout",
    "checkout_summary": "checkout", "checkout_payment": "payment", "order_confirmation": "order",
    "order_tracking": "post_purchase", "returns": "post_purchase", "help": "post_purchase",
}
CHECKOUT_PAGES = ["checkout_login", "checkout_address", "checkout_delivery", "checkout_summary", "checkout_payment"]
POST_PURCHASE_PAGES = ["order_tracking", "returns"]
OUTCOME_EVENTS = ["payment_success", "order_placed"]

# --- fixed values: privacy ------------------------------------------------------------------
FORBIDDEN_KEYS = [
    "card_number", "card", "cvv", "cvc", "expiry", "password", "otp", "otp_code", "pin", "upi_pin", "upi_id", "vpa",
    "address", "phone", "email", "name", "pincode",
]

# --- fixed values: session context and features ---------------------------------------------
CONTEXT_KEYS = ["device", "app_version", "city", "city_tier", "source", "is_logged_in"]
COUNTERS = {
    "product_views": "product_view", "size_chart_opens": "size_chart_open", "spec_opens": "spec_open",
    "review_opens": "review_open", "pincode_checks": "pincode_check", "delivery_info_views": "delivery_info_view",
    "searches": "search", "zero_result_searches": "search_zero_results", "rec_impressions": "rec_impression",
    "rec_clicks": "rec_click", "payment_attempts": "payment_attempt", "payment_failures": "payment_failed",
    "coupon_attempts": "coupon_apply", "coupon_failures": "coupon_failed", "coupons_applied": "coupon_applied",
    "login_walls": "login_wall", "otp_sends": "otp_sent", "otp_resends": "otp_resend", "otp_failures": "otp_failed",
    "login_successes": "login_success", "rage_clicks": "rage_click", "dead_clicks": "dead_click",
    "js_errors": "js_error", "slow_loads": "slow_load", "size_unavailable_clicks": "size_unavailable_click",
    "notify_me": "notify_me", "cart_removals": "remove_from_cart", "add_to_carts": "add_to_cart",
    "total_shown_count": "total_shown", "chat_opens": "chat_open", "help_views": "help_view",
    "tracking_views": "tracking_view", "returns_initiated": "return_initiated",
    "orders_cancelled": "order_cancelled", "checkout_starts": "checkout_start",
}
EXIT_GROUPS = {
    "exit_after_total_shown": ["total_shown"],
    "exit_after_payment_failure": ["payment_failed"],
    "exit_after_delivery_info": ["delivery_info_view", "pincode_check"],
    "exit_after_login": ["login_wall", "otp_sent", "otp_resend", "otp_failed"],
    "exit_after_coupon_failure": ["coupon_failed"],
    "exit_after_product_info": ["size_chart_open", "spec_open", "review_open"],
    "exit_after_oos": ["size_unavailable_click", "notify_me", "remove_from_cart"],
    "exit_after_error": ["js_error", "slow_load", "rage_click", "dead_click"],
    "exit_after_search": ["search", "search_zero_results"],
    "exit_after_recs": ["rec_impression"],
    "exit_after_tracking": ["tracking_view", "help_view"],
}
DEVICE_CODES = {"mobile_web": 0, "android_app": 1, "ios_app": 2, "desktop": 3}
SOURCE_CODES = {"direct": 0, "organic_search": 1, "paid_ads": 2, "social": 3, "email": 4, "push": 5}
CITY_TIERS = {"tier_1": 1, "tier_2": 2, "tier_3": 3}
STANDARD_TOTAL_KEYS = [
    "subtotal", "shipping", "platform_fee", "cod_fee", "discount", "total", "delta_pct", "payment_method",
]
INFO_RETURN_REASONS = ["not_as_described", "size_mismatch", "colour_different"]
QUALITY_RETURN_REASONS = ["damaged", "defective", "poor_quality"]

# --- fixed values: feature columns, in the order the models see them -------------------------
DWELL_COLUMNS = [f"dwell_{s}_s" for s in STEPS]
BEHAVIOUR_COLUMNS = [
    "n_events", "duration_s", "max_gap_s", "exit_dwell_s", *DWELL_COLUMNS, "furthest_step_idx", "current_step_idx",
    *COUNTERS,
    "unique_products", "pdp_loops", "checkout_cart_loops", "size_chart_unavailable", "max_review_page",
    "max_eta_days", "max_delivery_fee", "fee_first_shown", "oos_product_views", "method_switches",
    "payment_timeouts", "rage_clicks_checkout", "max_load_ms", "fatal_errors", "oos_removals", "cart_value",
    "max_total_delta_pct", "max_extra_fees", "cod_selected", "refund_pending_views", "delayed_status_views",
    "max_last_update_hours", "info_mismatch_returns", "quality_returns", *EXIT_GROUPS,
]
CONTEXT_COLUMNS = [
    "device_code", "is_android_app", "city_tier_num", "source_code", "logged_in_at_start", "hour", "is_weekend",
    "is_post_purchase",
]
Z_COLUMNS = [f"dwell_z_{s}" for s in STEPS] + ["max_dwell_z"]
FEATURE_COLUMNS = BEHAVIOUR_COLUMNS + CONTEXT_COLUMNS + Z_COLUMNS
CODED_CONTEXT = ["device_code", "source_code", "hour"]  # numbers that stand for names or times, not shown to people
JOIN_COLUMNS = [
    "n_payment_records", "failed_debited_payments", "n_gateways", "n_tickets", "n_reviews", "min_review_rating",
    "order_delay_days", "order_is_delayed", "order_refund_pending", "order_return_requested",
]

# --- fixed values: friction taxonomy ----------------------------------------------------------
FRICTIONS = [
    "unclear_product_info", "delivery_uncertainty", "payment_failure", "poor_recommendations",
    "post_purchase_concern", "price_shock", "coupon_failure", "login_otp_issue", "out_of_stock", "technical_glitch",
]
FRICTION_STAGE = {
    "poor_recommendations": 0, "unclear_product_info": 1, "out_of_stock": 1, "login_otp_issue": 3,
    "delivery_uncertainty": 4, "coupon_failure": 5, "price_shock": 6, "technical_glitch": 6, "payment_failure": 7,
    "post_purchase_concern": 9,
}
OWNER_TEAM = {
    "unclear_product_info": "product", "delivery_uncertainty": "operations", "payment_failure": "operations_tech",
    "poor_recommendations": "marketing", "post_purchase_concern": "customer_service", "price_shock": "marketing",
    "coupon_failure": "marketing", "login_otp_issue": "customer_service", "out_of_stock": "product",
    "technical_glitch": "operations_tech",
}
TEAM_VIEWS = {
    "customer_service": ["customer_service"], "marketing": ["marketing"], "product": ["product"],
    "operations": ["operations", "operations_tech"],
}
THEME_FRICTIONS = {
    "delivery_delay": ["delivery_uncertainty", "post_purchase_concern"],
    "size_fit": ["unclear_product_info", "out_of_stock"],
    "payment_trust": ["payment_failure"],
    "money_deducted": ["payment_failure"],
    "missing_info": ["unclear_product_info"],
    "return_refund": ["post_purchase_concern", "unclear_product_info"],
    "login_issue": ["login_otp_issue"],
    "stock": ["out_of_stock", "poor_recommendations"],
    "price_fees": ["price_shock", "coupon_failure", "delivery_uncertainty"],
    "app_bug": ["technical_glitch"],
    "other": [],
}
EVIDENCE_FEATURES = {
    "payment_failure": [
        "payment_attempts", "payment_failures", "method_switches", "payment_timeouts", "failed_debited_payments",
        "exit_after_payment_failure", "n_payment_records", "n_gateways", "dwell_payment_s", "dwell_z_payment"],
    "coupon_failure": ["coupon_attempts", "coupon_failures", "coupons_applied", "exit_after_coupon_failure"],
    "login_otp_issue": [
        "login_walls", "otp_sends", "otp_resends", "otp_failures", "login_successes", "exit_after_login",
        "logged_in_at_start"],
    "technical_glitch": [
        "rage_clicks", "rage_clicks_checkout", "dead_clicks", "js_errors", "slow_loads", "max_load_ms",
        "fatal_errors", "exit_after_error", "is_android_app", "device_code"],
    "price_shock": [
        "total_shown_count", "max_total_delta_pct", "max_extra_fees", "cod_selected", "checkout_cart_loops",
        "exit_after_total_shown", "cart_removals"],
    "unclear_product_info": [
        "size_chart_opens", "size_chart_unavailable", "spec_opens", "review_opens", "max_review_page", "pdp_loops",
        "unique_products", "product_views", "exit_after_product_info", "info_mismatch_returns", "dwell_product_s",
        "dwell_z_product"],
    "delivery_uncertainty": [
        "pincode_checks", "delivery_info_views", "max_eta_days", "max_delivery_fee", "fee_first_shown",
        "exit_after_delivery_info", "city_tier_num", "dwell_checkout_s", "dwell_z_checkout"],
    "poor_recommendations": [
        "searches", "zero_result_searches", "rec_impressions", "rec_clicks", "exit_after_search", "exit_after_recs",
        "dwell_browse_s", "dwell_z_browse"],
    "out_of_stock": [
        "size_unavailable_clicks", "notify_me", "oos_removals", "oos_product_views", "exit_after_oos"],
    "post_purchase_concern": [
        "tracking_views", "help_views", "orders_cancelled", "returns_initiated", "quality_returns",
        "refund_pending_views", "delayed_status_views", "max_last_update_hours", "exit_after_tracking",
        "is_post_purchase", "order_delay_days", "order_is_delayed", "order_refund_pending",
        "order_return_requested", "n_tickets", "dwell_post_purchase_s", "dwell_z_post_purchase"],
}

# --- fixed values: rules (name, friction, SQL predicate over the feature columns, meaning) -----
RULES = [
    ("payment_retry_x2", "payment_failure", "payment_failures >= 2", "2+ failed payment attempts"),
    ("money_deducted_failed_payment", "payment_failure", "failed_debited_payments >= 1",
     "failed payment where money was debited"),
    ("exit_after_payment_failure", "payment_failure", "exit_after_payment_failure = 1 AND payment_failures >= 1",
     "left right after a failed payment"),
    ("coupon_retry_x2", "coupon_failure", "coupon_failures >= 2", "2+ rejected coupon attempts"),
    ("exit_after_coupon_failure", "coupon_failure", "exit_after_coupon_failure = 1",
     "left right after a coupon was rejected"),
    ("otp_resend_x2", "login_otp_issue", "otp_resends >= 2", "OTP resent 2+ times"),
    ("otp_failed", "login_otp_issue", "otp_failures >= 1", "OTP verification failed"),
    ("exit_at_login_wall", "login_otp_issue", "exit_after_login = 1 AND login_successes = 0",
     "left at the login wall without logging in"),
    ("rage_click_checkout", "technical_glitch", "rage_clicks_checkout >= 1", "rage clicks on checkout/payment pages"),
    ("js_error", "technical_glitch", "js_errors >= 1", "JavaScript/app error shown"),
    ("slow_load_x2", "technical_glitch", "slow_loads >= 2 OR max_load_ms >= 6000",
     "2+ slow page loads or one load over 6 s"),
    ("dead_click_x3", "technical_glitch", "dead_clicks >= 3", "3+ clicks with no response"),
    ("rage_click_x2", "technical_glitch", "rage_clicks >= 2", "2+ rage-click bursts"),
    ("exit_after_total_shown", "price_shock", "exit_after_total_shown = 1",
     "left right after the order total was shown"),
    ("checkout_cart_loop", "price_shock", "checkout_cart_loops >= 1 AND total_shown_count >= 1",
     "went back from checkout to cart after seeing the total"),
    ("hidden_fees_shown", "price_shock", "max_extra_fees > 0", "extra fees appeared at checkout"),
    ("size_chart_x3", "unclear_product_info", "size_chart_opens >= 3", "size chart opened 3+ times"),
    ("spec_open_x3", "unclear_product_info", "spec_opens >= 3", "specs opened 3+ times"),
    ("pdp_compare_loop_x2", "unclear_product_info", "pdp_loops >= 2", "2+ product A-B-A comparison loops"),
    ("review_scan_x3", "unclear_product_info", "review_opens >= 3", "reviews opened 3+ times"),
    ("return_not_as_described", "unclear_product_info", "info_mismatch_returns >= 1",
     "return because item differed from the listing"),
    ("pincode_check_x3", "delivery_uncertainty", "pincode_checks >= 3", "delivery pincode checked 3+ times"),
    ("long_eta_exit", "delivery_uncertainty", "max_eta_days >= 7 AND exit_after_delivery_info = 1",
     "left after an ETA of 7+ days"),
    ("exit_after_delivery_info", "delivery_uncertainty", "exit_after_delivery_info = 1",
     "left right after delivery info was shown"),
    ("delivery_fee_revealed_late", "delivery_uncertainty", "fee_first_shown >= 1",
     "delivery fee first shown at checkout"),
    ("zero_result_search_x2", "poor_recommendations", "zero_result_searches >= 2", "2+ searches with no results"),
    ("search_reformulation_x3", "poor_recommendations", "searches + zero_result_searches >= 3",
     "3+ searches in one session"),
    ("recs_ignored_x4", "poor_recommendations", "rec_impressions >= 4 AND rec_clicks = 0",
     "4+ recommendation slots shown, none clicked"),
    ("oos_recs_clicked", "poor_recommendations", "oos_product_views >= 2 AND rec_clicks >= 2",
     "clicked 2+ recommendations that were out of stock"),
    ("size_unavailable_x2", "out_of_stock", "size_unavailable_clicks >= 2", "2+ clicks on unavailable sizes"),
    ("notify_me_clicked", "out_of_stock", "notify_me >= 1", "asked to be notified when back in stock"),
    ("cart_item_oos_removed", "out_of_stock", "oos_removals >= 1",
     "cart item removed because it went out of stock"),
    ("tracking_view_x3", "post_purchase_concern", "tracking_views >= 3", "order tracking checked 3+ times"),
    ("order_cancelled", "post_purchase_concern", "orders_cancelled >= 1", "order cancelled"),
    ("refund_pending_check", "post_purchase_concern", "refund_pending_views >= 1", "checked a pending refund"),
    ("delayed_order_viewed", "post_purchase_concern", "delayed_status_views >= 1",
     "tracking showed a delayed order"),
    ("return_quality_issue", "post_purchase_concern", "quality_returns >= 1",
     "return for damaged/defective/poor quality"),
]
RULE_FRICTION = {name: friction for name, friction, _, _ in RULES}

# --- fixed values: playbook --------------------------------------------------------------------
# (friction, kind, id, moment, channel, auto, template, when key, when values, allowed terms, description)
# Within one friction the first action whose condition holds wins, so the order is part of the data.
PLAYBOOK = [
    ("unclear_product_info", "customer", "fit_recommendation", "in_session", "in_app", True, "info_fit",
     "rule_any", ["size_chart_x3"], [], "Offer a fit recommendation from the product's measurements and reviews"),
    ("unclear_product_info", "customer", "comparison_table", "in_session", "in_app", True, "info_compare",
     "rule_any", ["pdp_compare_loop_x2"], [], "Show a side-by-side comparison of the products being compared"),
    ("unclear_product_info", "customer", "product_qa_assist", "in_session", "in_app", True, "info_qa",
     None, [], [], "Open the product Q&A assistant that answers from specs and reviews"),
    ("unclear_product_info", "customer", "product_info_followup", "post_session", "email", True, "info_followup",
     None, [], [], "Send the full specification sheet and size guide for the viewed product"),
    ("unclear_product_info", "customer", "easy_return_help", "post_purchase", "whatsapp", False, "info_return",
     None, [], ["return", "exchange"], "Help the customer with an easy return or exchange"),
    ("unclear_product_info", "team", "audit_flagged_listings", None, "task", False, "team_generic",
     "packet_type", ["aggregate"], [],
     "Audit the flagged product listings and add the missing size chart / attributes"),
    ("unclear_product_info", "team", "fix_product_content", None, "task", False, "team_generic",
     None, [], [], "Add the missing attributes, measurements or size chart to the product page"),
    ("delivery_uncertainty", "customer", "show_arrives_by_date", "in_session", "in_app", True, "delivery_date",
     None, [], [], "Show a clear arrives-by date and the faster delivery option"),
    ("delivery_uncertainty", "customer", "delivery_options_followup", "post_session", "push", True,
     "delivery_followup", None, [], [], "Share the delivery date and faster delivery options for the saved cart"),
    ("delivery_uncertainty", "team", "review_courier_performance", None, "task", False, "team_generic",
     "packet_type", ["aggregate"], [], "Review courier performance for the affected cities and reassign shipments"),
    ("delivery_uncertainty", "team", "show_fees_and_eta_early", None, "task", False, "team_generic",
     None, [], [], "Show delivery fee and ETA on the product page before checkout"),
    ("payment_failure", "customer", "refund_reassurance", "post_session", "whatsapp", False, "pay_refund",
     "rule_any", ["money_deducted_failed_payment"], ["refund", "reversed", "reversal"],
     "Confirm that any debited amount is reversed automatically and the cart is saved"),
    ("payment_failure", "customer", "alternate_method_nudge", "in_session", "in_app", True, "pay_alternate",
     None, [], [], "Suggest another payment method; the cart is saved"),
    ("payment_failure", "customer", "retry_payment_link", "post_session", "whatsapp", True, "pay_retry",
     None, [], [], "Send a one-tap link to retry payment with another method"),
    ("payment_failure", "team", "check_or_switch_gateway", None, "task", False, "team_generic",
     "packet_type", ["aggregate"], [],
     "Check gateway health and route payment traffic away from the failing gateway"),
    ("payment_failure", "team", "review_payment_errors", None, "task", False, "team_generic",
     None, [], [], "Review payment error codes for this gateway and method"),
    ("poor_recommendations", "customer", "in_stock_alternatives", "in_session", "in_app", True, "recs_instock",
     None, [], [], "Show similar in-stock items based on what the customer viewed this session"),
    ("poor_recommendations", "customer", "personalised_picks_followup", "post_session", "email", True,
     "recs_followup", None, [], [], "Send picks based on this session's searches and views"),
    ("poor_recommendations", "team", "tune_recommendations", None, "task", False, "team_generic",
     None, [], [], "Review recommendation slots with no clicks and search terms with no results"),
    ("post_purchase_concern", "customer", "refund_status_update", "post_purchase", "email", False, "pp_refund",
     "rule_any", ["refund_pending_check"], ["refund"], "Send the current refund status"),
    ("post_purchase_concern", "customer", "proactive_delay_update", "post_purchase", "whatsapp", True, "pp_delay",
     "rule_any", ["tracking_view_x3", "delayed_order_viewed"], [],
     "Send a proactive update with the latest delivery status"),
    ("post_purchase_concern", "customer", "assisted_support_reply", "post_purchase", "whatsapp", False,
     "pp_support", None, [], [], "Customer service replies with an AI-drafted, human-approved message"),
    ("post_purchase_concern", "team", "escalate_courier_delays", None, "task", False, "team_generic",
     "packet_type", ["aggregate"], [], "Escalate delayed shipments with the courier and notify affected customers"),
    ("post_purchase_concern", "team", "review_order_issue", None, "task", False, "team_generic",
     None, [], [], "Review the order and reply to the customer"),
    ("price_shock", "customer", "show_cost_breakdown", "in_session", "in_app", True, "price_breakdown",
     None, [], ["free shipping"], "Show the full cost breakdown and the free-shipping threshold"),
    ("price_shock", "customer", "saved_cart_reminder", "post_session", "email", True, "price_reminder",
     None, [], [], "Remind the customer about the saved cart with the full price shown upfront"),
    ("price_shock", "team", "show_full_cost_early", None, "task", False, "team_generic",
     None, [], [], "Show all fees on the product and cart pages instead of only at checkout"),
    ("coupon_failure", "customer", "explain_coupon_rejection", "in_session", "in_app", True, "coupon_explain",
     None, [], ["coupon"], "Explain why the coupon was rejected and where to see currently valid coupons"),
    ("coupon_failure", "customer", "valid_coupon_followup", "post_session", "email", False, "coupon_followup",
     None, [], ["coupon"], "Share the currently valid coupons for the saved cart (needs approval)"),
    ("coupon_failure", "team", "fix_coupon_rules", None, "task", False, "team_generic",
     None, [], [], "Review coupon validity rules and rejection messages"),
    ("login_otp_issue", "customer", "alternate_otp_channel", "in_session", "in_app", True, "login_channel",
     "rule_any", ["otp_resend_x2", "otp_failed"], [], "Offer the OTP by WhatsApp or email instead of SMS"),
    ("login_otp_issue", "customer", "offer_guest_checkout", "in_session", "in_app", True, "login_guest",
     None, [], [], "Offer guest checkout so the customer can continue without logging in"),
    ("login_otp_issue", "customer", "login_help_followup", "post_session", "email", True, "login_followup",
     None, [], [], "Send a login help link with guest checkout for the saved cart"),
    ("login_otp_issue", "customer", "login_help_tracking", "post_purchase", "email", True, "login_followup",
     None, [], [], "Send a login help link to track the order"),
    ("login_otp_issue", "team", "check_otp_delivery", None, "task", False, "team_generic",
     None, [], [], "Check OTP delivery rates with the SMS provider"),
    ("out_of_stock", "customer", "similar_in_stock", "in_session", "in_app", True, "oos_similar",
     None, [], [], "Show similar items that are in stock in the customer's size"),
    ("out_of_stock", "customer", "back_in_stock_alert", "post_session", "push", True, "oos_alert",
     None, [], [], "Alert the customer when the item is back in stock"),
    ("out_of_stock", "team", "restock_popular_sizes", None, "task", False, "team_generic",
     None, [], [], "Restock popular sizes and hide unavailable sizes in recommendations"),
    ("technical_glitch", "customer", "retry_fallback_page", "in_session", "in_app", True, "tech_retry",
     None, [], [], "Offer a reload / lightweight fallback page; the cart is saved"),
    ("technical_glitch", "customer", "saved_cart_followup", "post_session", "email", True, "tech_followup",
     None, [], [], "Let the customer know the issue is being fixed and the cart is saved"),
    ("technical_glitch", "customer", "tracking_help", "post_purchase", "email", True, "tech_followup",
     None, [], [], "Send the order status directly while the tracking page is fixed"),
    ("technical_glitch", "team", "raise_tech_incident", None, "task", False, "team_generic",
     None, [], [], "Raise a tech incident with the error details and the affected device / app version"),
]
TEMPLATES = {
    "info_fit": "Not sure about the size of the {product}? Here is a fit recommendation based on its measurements"
                " and customer reviews.",
    "info_compare": "Comparing options? Here is a side-by-side view of the {product} and similar items to help you"
                    " decide.",
    "info_qa": "Have a question about the {product}? Ask our product assistant - it answers from the specifications"
               " and reviews.",
    "info_followup": "Still deciding on the {product}? Here are the full specifications and size guide. Your cart"
                     " is saved.",
    "info_return": "Sorry the {product} was not what you expected. We can help you with an easy return or exchange.",
    "delivery_date": "Your {product} can arrive by the date shown at checkout, and a faster delivery option is"
                     " available.",
    "delivery_followup": "Your cart is saved. Check the delivery date and faster delivery options for your"
                         " {product}.",
    "pay_refund": "Your payment did not go through. If any amount was debited, it is reversed to your account"
                  " automatically. Your cart is saved.",
    "pay_alternate": "Payment by {method} is not going through right now. You can pay another way - your cart is"
                     " saved.",
    "pay_retry": "Your payment did not complete. Your cart is saved - tap to try again with another payment method.",
    "recs_instock": "Here are similar items in stock, based on what you looked at today.",
    "recs_followup": "We picked a few items based on what you searched for. Take a look when you have a moment.",
    "pp_refund": "Here is the latest status of your refund. We will keep you updated.",
    "pp_delay": "Here is the latest update on your order. We are sorry for the wait and are keeping an eye on it.",
    "pp_support": "Thanks for reaching out. Our team has looked into your order and will help you right away.",
    "price_breakdown": "Here is the full cost breakdown for your cart, including all charges and the free shipping"
                       " threshold.",
    "price_reminder": "Your cart is saved. The full price, including all charges, is shown upfront.",
    "coupon_explain": "That coupon could not be applied to this cart. Here is why, and where to see the coupons that"
                      " are valid right now.",
    "coupon_followup": "Your cart is saved. Here are the coupons that are valid for it right now.",
    "login_channel": "Not getting the OTP? We can send it by WhatsApp or email instead.",
    "login_guest": "You can continue as a guest - no login needed to complete your order.",
    "login_followup": "Having trouble logging in? Use this help link - you can also check out as a guest.",
    "oos_similar": "Your size is unavailable right now. Here are similar items in stock.",
    "oos_alert": "We will let you know as soon as the {product} is back in stock.",
    "tech_retry": "Sorry, something went wrong on this page. Please reload - your cart is saved.",
    "tech_followup": "Sorry about the trouble earlier. We are fixing it, and your cart is saved.",
    "team_generic": "{action}",
}

# --- fixed values: wording of alerts and explanations -------------------------------------------
FRICTION_LABELS = {
    "unclear_product_info": "Unclear product information", "delivery_uncertainty": "Delivery uncertainty",
    "payment_failure": "Payment failures", "poor_recommendations": "Poor recommendations",
    "post_purchase_concern": "Post-purchase concerns", "price_shock": "Hidden costs / price shock",
    "coupon_failure": "Coupon failure", "login_otp_issue": "Forced login / OTP issues",
    "out_of_stock": "Out of stock / size unavailable", "technical_glitch": "Technical glitches",
}
LIKELY_CAUSES = {
    "unclear_product_info":
        "Product page is missing information customers need to decide (size chart, specs or attributes).",
    "delivery_uncertainty": "Delivery date or fee was unclear or too long for the customer's location.",
    "payment_failure": "Payment method or gateway instability, not price.",
    "poor_recommendations": "Search and recommendation slots are not surfacing relevant, in-stock items.",
    "post_purchase_concern":
        "Order status is not communicated well enough after purchase (delays, refunds or quality).",
    "price_shock": "Extra charges appear late in checkout, so the final total surprises the customer.",
    "coupon_failure": "Coupon rules or error messages do not match what customers expect.",
    "login_otp_issue": "Forced login and OTP delivery block customers from completing checkout.",
    "out_of_stock": "The wanted item or size is unavailable and alternatives are not compelling.",
    "technical_glitch": "A page or app error is blocking the customer from continuing.",
}
METRIC_LABELS = {
    "payment_session_failure_rate": "payment failure rate",
    "long_eta_share": "share of long delivery estimates",
    "delayed_order_share": "share of delayed orders",
    "size_chart_no_add_rate": "rate of size-chart views without add to cart",
    "negative_feedback_rate": "negative feedback rate",
    "error_session_rate": "error rate",
}

# --- fixed values: workflow states (action -> states it may start from, state it leads to) -------
OPEN_STATES = ["open", "needs_review", "approved", "assigned"]
CLOSED_STATES = ["dismissed", "resolved"]
TRANSITIONS = {
    "approve": (["open", "needs_review", "assigned"], "approved"),
    "assign": (["open", "needs_review", "approved"], "assigned"),
    "create_ticket": (OPEN_STATES, None),
    "dismiss": (OPEN_STATES, "dismissed"),
    "resolve": (["approved", "assigned"], "resolved"),
}

# --- fixed values: draft checks -------------------------------------------------------------------
NUMBER_PATTERN = r"(?<![A-Za-z_])\d[\d,]*(?:\.\d+)?%?"
EMAIL_PATTERN = r"[\w.+-]+@[\w-]+\.[\w.]+"
PHONE_PATTERN = r"(?:\+91[\s-]?)?\b[6-9]\d{9}\b"
ID_PATTERN = r"\b(?:u_[0-9a-f]{6,}|s_\d{4,}(?:_\d+)?|o_\d{4,}|pay_\d{4,}|t_\d{4,}|c_\d{4,}|r_\d{4,})\b"
URL_PATTERN = r"https?://|www\."
FRICTION_PHRASES = {
    "unclear_product_info": ["unclear product info"], "delivery_uncertainty": ["delivery uncertainty"],
    "payment_failure": ["payment failure"], "poor_recommendations": ["poor recommendation"],
    "post_purchase_concern": ["post-purchase concern", "post purchase concern"],
    "price_shock": ["price shock", "hidden cost"], "coupon_failure": ["coupon failure"],
    "login_otp_issue": ["login/otp issue", "otp issue", "login issue"],
    "out_of_stock": ["out of stock", "out-of-stock"], "technical_glitch": ["technical glitch"],
}
OFFER_TERMS = [
    "discount", "% off", "cashback", "cash back", "voucher", "promo code", "coupon", "free gift", "gift card",
    "store credit", "compensation", "compensate", "refund", "reimburse", "waive", "free delivery", "free shipping",
    "reversed", "reversal",
]
BANNED_PHRASES = [
    "guarantee", "promise", "100%", "lawsuit", "legal action", "your fault", "stupid", "idiot", "damn", "shut up",
]

# --- fixed values: columns an investigation reports ------------------------------------------------
COMPARED_FEATURES = ["payment_failures", "coupon_failures", "otp_resends", "size_chart_opens", "pincode_checks",
                     "max_eta_days", "max_extra_fees", "rage_clicks", "js_errors", "dwell_checkout_s"]
PRODUCT_DETAILS = ["product_id", "name", "category", "subcategory", "price", "rating", "n_reviews", "has_size_chart",
                   "sizes", "missing_attributes", "spec_completeness", "image_count", "return_window_days", "in_stock"]
