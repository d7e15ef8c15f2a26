"""Word lists of the privacy layer. Results depend on them. Larger vocabularies are DataFrames that the caller loads."""
from __future__ import annotations

#: Short forms of the trade, which are no host names.
SECURITY_ACRONYMS = (
    "MITRE ATT CK ATT-CK CISA KEV NIST ISO SOC SIEM EDR XDR MDR NDR DLP MFA SSO VPN RDP SMB DNS DHCP LDAP SAML OAUTH API URL URI PII IOC IOA TTP APT C2 TLS "
    "SSL HTTP HTTPS FTP SSH WAF IDS IPS AV UEBA SOAR CVE CVSS NVD OWASP PDF EXE DLL PS1 VBA LOLBIN AD DC GPO PAM IAM T1486 T1059 T1027 US-CERT SANS FBI NSA "
    "GDPR PDPL SLA RTO RPO IT OT ICS SCADA IOT SMS OTP CSV JSON XML SQL CPU RAM USB LAN WAN NAC XSS CSRF SSRF IDOR LFI RFI XXE RCE BEC RAT POS MSP MSSP CI "
    "CD GPU HR CFO CEO CISO CTO CIO COO PHI PCI DSS HIPAA NCA ECC SAMA SWIFT ATM GMT UTC AST AM PM ID IDS OK FAQ SFTP TFTP SMTP IMAP POP3 SNMP ICMP VNC NFS "
    "WMI WINRM NTLM LSASS NTDS SAM UAC COM DCOM RPC KDC TGT SPN OU LNK ISO CHM HTA MSI VBS JS JAR ZIP RAR OS VM VPS CDN DGA P2P IRC TCP UDP IP MAC NAT ACL "
    "VLAN DMZ AWS GCP S3 EC2 ESXI 3DES 2FA BIOS UEFI MBR IIS OWA ADFS JWT SIM DDOS DOS MITM AITM OSINT TI CTI DFIR IR BCP DRP KPI ROI SAAS PAAS IAAS PLC "
    "HMI RTU SIS BMS ERP CRM EHR EMR PACS POC QA UAT "
).split()

#: What mixes letters and digits without naming a machine.
TECH_PREFIXES = (
    "sha md base aes rc des tdes utf ipv wpa oauth log win windows ios tls ssl http https smb python java net dotnet esxi office port sql mssql rhel ubuntu "
    "debian centos server exchange sharepoint vista cve ms kb apt unc ta gmt utc tcp udp ntlm cis iso pci nist rsa ecc dh pbkdf crc blake hex uint int amd "
    "arm intel core gen usb covid syswow advapi ntdll x509 type rule event eventid code error status version ver rev build patch sp vlan "
).split()

#: Words that say what kind of body, role or section something is.
STRUCTURE_WORDS = (
    "inc llc ltd limited corp corporation company co gmbh plc llp bank group holdings centre center hospital clinic authority ministry university college "
    "institute agency foundation association council commission trust department division unit office board committee team desk chief information security "
    "officer incident commander crisis management business continuity plan disaster recovery service help operations legal finance financial accounting "
    "human resources procurement sales marketing engineering development research compliance audit risk governance executive director manager head lead "
    "senior junior analyst engineer administrator admin architect consultant contractor vendor supplier partner customer client employee staff user owner "
    "president vice deputy secretary treasurer tier level phase stage step severity priority critical high medium low table figure appendix section annex "
    "version day week month year quarter internet intranet web cloud january february march april may june july august september october november december "
    "jan feb mar apr jun jul aug sep sept oct nov dec monday tuesday wednesday thursday friday saturday sunday gb mb kb tb gbps mbps kbps hz ghz ms usd sar "
    "eur gbp aed kwd qar bhd omr egp jpy cny inr btc eth mr mrs ms dr eng "
).split()

#: Last words of capitalised terms of the trade.
TERM_HEADS = (
    "authentication authorization services service server servers system systems management strategy policy policies programme program framework plan plans "
    "process processes procedure procedures controls control assessment review monitoring protection detection response recovery access directory gateway "
    "firewall platform governance security operations essentials regulations standard standards requirements guidance assurance architecture infrastructure "
    "portfolio software hardware segmentation encryption backup backups logging testing training awareness "
).split()

#: Words that open sentences and are never a name.
FUNCTION_WORDS = (
    "the a an at in on after during when while since before by from to for with and but or if as of this that these those our their its his her no not all "
    "both each every some any several many most per via then once although however meanwhile later initially subsequently finally also additionally there "
    "here it they we he she i you who what which where why how within without between among against under over into onto upon about above below across "
    "around near until unless because so yet nor either neither once twice approximately roughly nearly almost only just even still already further "
    "moreover furthermore therefore thus hence next first second third last one two three four five six seven eight nine ten "
).split()

#: Written numbers.
NUMBER_WORDS = (
    "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty first second third "
    "fourth fifth sixth seventh eighth ninth tenth "
).split()

#: What a person does in a report.
PERSON_VERBS = (
    "clicked opened received reported entered noticed approved forwarded downloaded said called confirmed logged signed replied sent submitted provided "
    "shared ran executed installed accessed typed answered accepted visited responded escalated authorised authorized contacted emailed "
).split()

#: What an organisation does in a report.
ORG_VERBS = (
    "disclosed confirmed announced said stated acknowledged admitted revealed notified paid declined refused hired engaged published warned apologised "
    "apologized sued agreed reported detected discovered suffered experienced learned "
).split()

#: Plural subjects that are no organisation.
GENERIC_SUBJECTS = (
    "investigators analysts researchers attackers adversaries actors operators criminals hackers intruders staff employees users customers clients patients "
    "students officials authorities police regulators auditors responders defenders administrators engineers developers vendors suppliers partners "
    "executives management leadership forensics logs systems servers services backups files data records alerts sensors tools controls teams hospitals "
    "banks companies organisations organizations agencies operations production sales payments monitoring telemetry logging analysis investigation review "
    "testing detection response containment recovery encryption exfiltration access email traffic authentication everything nothing someone nobody "
).split()

#: What follows the name of an attacker.
THREAT_ACTOR_WORDS = (
    "ransomware gang group actor actors operators operator affiliate affiliates crew team malware variant strain locker encryptor collective "
).split()

UNIT_WORDS = "department departments team teams unit units division function functions directorate staff".split()
#: Names of functions that end like an organisation's.
NO_ORGANISATIONS = [
    "security operations centre", "security operations center", "network operations centre", "network operations center", "operations centre", "operations center", "data centre", "data center",
    "command centre", "command center", "call centre", "call center", "contact centre", "contact center", "service centre", "service center", "incident response centre",
]
