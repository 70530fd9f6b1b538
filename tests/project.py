"""A small hand-written metadata project."""

from pathlib import Path

NS = 'xmlns="http://soap.sforce.com/2006/04/metadata"'

FLOW = f"""<?xml version="1.0" encoding="UTF-8"?>
<Flow {NS}>
  <apiVersion>58.0</apiVersion><processType>AutoLaunchedFlow</processType><status>Active</status><label>Case_Router</label>
  <start><object>Case</object></start>
  <variables><name>in</name><dataType>String</dataType><isInput>true</isInput></variables>
  <decisions><name>Check</name><label>Is it hot?</label><locationX>1</locationX>
    <rules><name>yes</name><conditions><leftValueReference>Case.Heat__c</leftValueReference></conditions><connector><targetReference>Save</targetReference></connector></rules>
    <defaultConnector><targetReference>Done</targetReference></defaultConnector></decisions>
  <recordUpdates><name>Save</name><object>Account</object><filters><field>Id</field></filters>
    <connector><targetReference>Done</targetReference></connector><faultConnector><targetReference>Oops</targetReference></faultConnector></recordUpdates>
  <assignments><name>Done</name><assignmentItems><value>Done.</value></assignmentItems></assignments>
  <formulas/>
</Flow>"""

RULE = f"""<ValidationRule {NS}><fullName>Need_Mail</fullName><active>true</active>
<errorConditionFormula>AND(ISBLANK(Email__c), OR($User.Rank__c = 1, FLOOR(Amount__c) &gt; 2))</errorConditionFormula>
<errorMessage>Ask info@corp.example.com</errorMessage></ValidationRule>"""

OBJECT = f"""<CustomObject {NS}><sharingModel>Private</sharingModel><enableSearch>true</enableSearch><nameField><type>Text</type></nameField>
<actionOverrides><actionName>View</actionName><type>Flexipage</type></actionOverrides>
<actionOverrides><actionName>New</actionName><type>Default</type></actionOverrides></CustomObject>"""


def field(name: str, body: str = "<type>Text</type><length>80</length>") -> str:
    return f"<CustomField {NS}><fullName>{name}</fullName>{body}</CustomField>"


REPORT = f"""<Report {NS}><name>Open_Cases</name><reportType>CaseList</reportType><format>Summary</format>
<columns><field>CASE.SUBJECT</field></columns><columns><field>CASE.AGE</field><aggregateTypes>Average</aggregateTypes></columns>
<filter><booleanFilter>1</booleanFilter><criteriaItems><column>STATUS</column><operator>equals</operator></criteriaItems></filter>
<groupingsDown><field>OWNER</field><sortOrder>Asc</sortOrder></groupingsDown><chart><chartType>Donut</chartType></chart></Report>"""

LAYOUT = f"""<Layout {NS}><layoutSections><label>Main</label><style>TwoColumns</style>
<layoutColumns><layoutItems><behavior>Edit</behavior><field>Name</field></layoutItems><layoutItems><behavior>Readonly</behavior></layoutItems></layoutColumns>
<layoutColumns><layoutItems><behavior>Required</behavior><field>Tier__c</field></layoutItems></layoutColumns></layoutSections>
<relatedLists><fields>TASK.SUBJECT</fields><relatedList>Tasks</relatedList></relatedLists></Layout>"""

SCRIPT = """import { LightningElement, api, wire } from 'lwc';
import getRows from '@salesforce/apex/RowController.getRows';
import NAME from '@salesforce/schema/Account.Name';
export default class RowList extends LightningElement {
  @api recordId; @track rows;
  @wire(getRecord, { recordId: '$recordId' }) record;
  connectedCallback() {} handleClick() { new ShowToastEvent(); }
}"""
PAGE = '<template><c-row-item for:each={rows} lwc:if={ready}></c-row-item><lightning-input></lightning-input></template>'
META = "<x><apiVersion>59.0</apiVersion><isExposed>true</isExposed><target>lightning__RecordPage</target><objects><object>Account</object></objects></x>"

APEX = """public with sharing class CaseService implements Queueable, Schedulable {
  @AuraEnabled public static List<Case> load(Id a, String b) { return [SELECT Id FROM Case WHERE Id = :a]; }
  private void store(Case c) { update c; }
}"""


def write(base: Path) -> Path:
    root = base / "acme" / "force-app" / "main" / "default"
    files = {
        "flows/Case_Router.flow-meta.xml": FLOW,
        "flows/Broken.flow-meta.xml": "<Flow><label>",
        "objects/Case/validationRules/Need_Mail.validationRule-meta.xml": RULE,
        "objects/Case/Case.object-meta.xml": OBJECT,
        "objects/Case/fields/AcmeCloud_Tier__c.field-meta.xml": field("AcmeCloud_Tier__c"),
        "objects/Lead/fields/AcmeCloud_Tier__c.field-meta.xml": field("AcmeCloud_Tier__c"),
        "objects/Lead/fields/SoloBrand_Tier__c.field-meta.xml": field("SoloBrand_Tier__c", "<type>Lookup</type><referenceTo>Account</referenceTo><label>  </label>"),
        "objects/Lead/fields/mkto_si__Score__c.field-meta.xml": field("mkto_si__Score__c", "<type>Number</type><formula>1 + 1</formula>"),
        "objects/Lead/fields/Bad__c.field-meta.xml": "<CustomField><fullName>",
        "reports/Open.report-meta.xml": REPORT,
        "layouts/Case-Case_Layout.layout-meta.xml": LAYOUT,
        "layouts/Plain.layout-meta.xml": LAYOUT,
        "lwc/rowList/rowList.js": SCRIPT,
        "lwc/rowList/rowList.html": PAGE,
        "lwc/rowList/rowList.js-meta.xml": META,
        "lwc/bare/bare.js": "export default class Bare {}",
        "lwc/bare/helper.js": "// no component",
        "classes/CaseService.cls": APEX,
        "classes/EmptyTest.cls": "@IsTest class EmptyTest {}",
        "other/Lost.cls": APEX,
        ".hidden/Extra.report-meta.xml": REPORT,
    }
    for name, text in files.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    return base / "acme"
