"""Vocabularies whose members decide results. Longer word lists are parameters."""

from __future__ import annotations

# Fixed values. Key prefixes of record ids.
RECORD_ID_PREFIXES = tuple(
    """
    001 003 005 006 00Q 00D 00e 00G 00I 012 015 01I 01p 01q 01s 01t 01Z 02i 02s 035 03d 04t 050 058 068
    069 07M 08s 0Af 0AP 500 570 701 800 801
    """.split()
)

# Fixed values. Objects that every org has.
STANDARD_OBJECTS = tuple(
    """
    Account Contact Lead Opportunity Case Task Event User Group Profile Role PermissionSet Campaign
    CampaignMember Contract Order OrderItem Product2 PricebookEntry Pricebook2 Quote QuoteLineItem
    Solution ContentDocument ContentVersion Attachment Note FeedItem FeedComment Dashboard Report
    EmailMessage EmailTemplate Folder BusinessHours Holiday RecordType Organization UserRole GroupMember
    OpportunityLineItem OpportunityContactRole AccountContactRelation ContactPointAddress
    """.split()
)

# Fixed values. Fields that every org has.
STANDARD_FIELDS = tuple(
    """
    Id Name OwnerId CreatedById CreatedDate LastModifiedById LastModifiedDate SystemModstamp IsDeleted
    RecordTypeId CurrencyIsoCode FirstName LastName Email Phone MobilePhone Title Department Description
    Website BillingStreet BillingCity BillingState BillingPostalCode BillingCountry ShippingStreet
    ShippingCity ShippingState ShippingPostalCode ShippingCountry Industry AnnualRevenue
    NumberOfEmployees StageName CloseDate Amount Probability Type Status Priority Subject AccountId
    ContactId LeadId OpportunityId ParentId CaseId WhatId WhoId IsActive IsClosed IsWon
    """.split()
)

# Fixed values. Products whose names may stay: they tell of integrations.
ECOSYSTEM_PRODUCTS = tuple(
    """
    marketo mkto pardot eloqua hubspot mailchimp exacttarget salesforcemktg demandbase 6sense bombora
    terminus rollworks triblio zoominfo clearbit dun dnb hoovers leadiq lusha apollo cognism seamless
    slintel outreach salesloft gong chorus clari groove xactly velocify ringdna orum conga apttus
    docusign pandadoc zuora chargebee recurly avalara mulesoft jitterbit informatica talend workato tray
    celigo boomi snaplogic linkedin slack twilio sendgrid ringcentral vonage bandwidth plivo talkdesk
    zendesk freshdesk intercom drift qualified livechat chatbot ada tableau domo looker powerbi qlik
    sisense jira asana monday smartsheet wrike basecamp confluence notion netsuite quickbooks xero sage
    intacct workday coupa ariba certify expensify ringlead cloudingo cloudinga usergem clay datagrail
    validity people dupe showpad highspot seismic calendly chili formstack netdocuments adobe echosign
    hellosign npsp npe hed sfims dlrs bizible bizible2 bizibleid mkto_si mkto71 x6sense lsf sked
    cventsfdc rh2 lnt dozisf zvc
    """.split()
)

# Fixed values. Words of which descriptive compound names are made.
COMMON_FIELD_WORDS = tuple(
    """
    is has can do get set add run show hide send sync find check create update delete merge convert
    assign match evaluate calculate resolve start stop close open lock unlock submit approve reject
    cancel complete process handle trigger new old past current previous next prior last first active
    inactive primary secondary default custom standard manual auto mass bulk no longer within target
    matching linked related associated account contact lead opportunity case task event user role
    profile group team queue member company person persona firm org organization customer name date time
    type status stage step phase score rating tier level count total sum amount number record field
    value key index code email phone address city state country street job title department division
    region territory info infos data note notes detail details url link path source ref reference id by
    at to for of in on from with month year day week hour quarter annual daily created modified updated
    started ended closed relationship lookup master junction rollup formula workflow approval permission
    sharing owner billing shipping mailing
    """.split()
)

# Fixed values. Company names that are everyday words.
TOO_COMMON_ALONE = tuple(
    """
    apple oracle target delta uber snap block square unity match dish visa ford shell cardinal frontier
    summit pinnacle global national american united premier standard general liberty patriot guardian
    advance progressive select prime universal allied pacific atlantic southern northern western eastern
    central mutual trust fidelity pioneer quest genesis spark relay pulse core vertex apex nexus harbor
    beacon bridge compass insight horizon catalyst terra nova spectrum resolve charter century diamond
    sterling marathon tribune merit legacy status custom direct form field record report contact account
    order product asset quote value source owner parent active total amount score action event alert
    update create review submit access share public current complete region response request notice
    renewal invoice payment credit balance limit impact connect focus engage encore integrity express
    pilot contract vendor partner client prospect campaign batch schedule trigger method process
    workflow origin type lead case task note role
    """.split()
)

# Fixed values. Endings that are dropped from company names, the longest that fits once.
COMPANY_SUFFIXES = tuple(
    " " + x
    for x in (
        "incorporated",
        "inc.",
        "inc",
        "corporation",
        "corp.",
        "corp",
        "company",
        "co.",
        "co",
        "llc",
        "ltd.",
        "ltd",
        "l.p.",
        "lp",
        "plc",
        "group",
        "holdings",
        "holding",
        "international",
        "intl",
        "n.a.",
        "s.a.",
        "ag",
        "se",
        "nv",
        "& co.",
        "& co",
        "enterprises",
        "industries",
        "solutions",
        "services",
        "technologies",
        "technology",
        "partners",
        "associates",
        "financial",
        "bancorp",
        "bancshares",
        "bankcorp",
        "brands",
        "systems",
        "networks",
        "communications",
        "health",
        "healthcare",
        "pharma",
        "therapeutics",
        "biosciences",
        "sciences",
        "labs",
        "laboratories",
        "de",
        "sa",
        "spa",
        "gmbh",
        "pty",
        "bv",
    )
)

# Fixed values. Words that are no keywords.
STOP_WORDS = tuple(
    """
    a an the and or but in on at to for of with by from is are was were be been being have has had do
    does did will would could should may might shall can need must that this these those i we you it
    they me him her us them my your his its our their what which who whom when where why how all each
    every both few more most other some such no not only same so than too very just build create make
    add implement setup configure
    """.split()
)

# Fixed values. Functions looked for in formulas, in this order.
FORMULA_FUNCTIONS = tuple(
    """
    AND OR NOT IF CASE ISBLANK ISNULL ISPICKVAL ISCHANGED ISNEW PRIORVALUE TEXT VALUE LEN LEFT RIGHT MID
    CONTAINS BEGINS INCLUDES TODAY NOW DATEVALUE DATETIMEVALUE YEAR MONTH DAY REGEX SUBSTITUTE TRIM
    NULLVALUE BLANKVALUE HYPERLINK IMAGE
    """.split()
)

# Fixed values. Types that extractors emit, by category.
CATEGORIES = {
    "Flow Logic": (
        "flow_full flow_decision flow_record_lookup flow_record_update flow_record_create flow_record_delete "
        "flow_screen flow_assignment flow_loop flow_action_call flow_subflow flow_formula flow_collection_processor"
    ).split(),
    "Data Validation": ["validation_rule"],
    "Data Model": ["object_definition", "field_definition"],
    "UI Component": ["lwc_component"],
    "Reporting": ["report_definition"],
    "Page Layout": ["layout_definition"],
    "Apex Logic": ["apex_class"],
}

# Fixed values. Labels of complexity 1 to 5.
COMPLEXITY_LABELS = ("Basic", "Simple", "Moderate", "Complex", "Expert")

# Fixed values. Weights of complexity factors (others weigh 1) and the highest scores of 1 to 4.
COMPLEXITY_WEIGHTS = {
    "decisions": 3, "loops": 3, "record_ops": 2, "screens": 2, "conditions": 1,
    "formulas": 2, "fields": 0.5, "elements": 0.3, "nesting_depth": 4, "subflows": 3,
}
COMPLEXITY_STEPS = (3, 8, 18, 35)

# Fixed values. Colours that categories are shown in.
CATEGORY_COLORS = {
    "Flow Logic": "#3b82f6",
    "Data Validation": "#22c55e",
    "Data Model": "#a855f7",
    "UI Component": "#f97316",
    "Reporting": "#eab308",
    "Page Layout": "#06b6d4",
    "Apex Logic": "#ef4444",
}
