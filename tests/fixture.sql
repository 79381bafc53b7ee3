-- A clinic's books, written for these tests.
CREATE TABLE patients (
    patient_no BIGINT PRIMARY KEY,
    family_name TEXT NOT NULL,
    bvn VARCHAR(11), -- from the old register
    nin VARCHAR(11), -- from the old register
    old_card_pan CHAR(19)
);

CREATE TABLE fee_journal (
    line_no BIGINT PRIMARY KEY,
    patient_no BIGINT REFERENCES patients (patient_no) ON DELETE CASCADE,
    credit NUMERIC(12,2) NOT NULL,
    posted_on DATE
);

CREATE TABLE payout_log (
    payout_no BIGINT PRIMARY KEY,
    amount NUMERIC(12,2),
    bank TEXT
);
